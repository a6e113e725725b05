"""Named curves, computed when they are asked for: `close|diff-1|mean-4` is the mean of 4 rows of the difference of `close`.

A block is a registered name with numbers after dashes. `with_curves` starts from the longest beginning of a name that the
frame already has as a column, so nothing is computed twice, and keeps the curves it passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.windows import SERIES, full, near, ordered, trailing

#: name -> (rows before a row that the curve looks at, function of source column, window key and numbers)
BLOCKS: dict[str, tuple[Callable, Callable]] = {}


def block(name: str, before: Callable = lambda *n: 0):
    """Register a block; `before` gives, from its numbers, how many earlier rows it looks at."""

    def add(fn):
        BLOCKS[name] = (before, fn)
        return fn

    return add


@block("diff", lambda n: n)
def _diff(x: str, key, n: int) -> Column:
    return F.col(x) - F.lag(x, n).over(ordered(key))


@block("mean", lambda n: n)
def _mean(x: str, key, n: int) -> Column:
    return full(F.col(x), F.avg(x), n, trailing(n, key))


@block("stddev", lambda n: n)
def _stddev(x: str, key, n: int) -> Column:
    return full(F.col(x), F.stddev_pop(x), n, trailing(n, key))


@block("var", lambda n: n)
def _var(x: str, key, n: int) -> Column:
    return full(F.col(x), F.var_pop(x), n, trailing(n, key))


@block("top", lambda n: n)
def _top(x: str, key, n: int) -> Column:
    return full(F.col(x), F.max(x), n, trailing(n, key))


@block("abs")
def _abs(x: str, key) -> Column:
    return F.abs(F.col(x))


@block("round")
def _round(x: str, key, places: int) -> Column:
    return F.round(F.col(x), places)


def missing(columns: list[str], curves: list[str]) -> list[tuple[str, str, str, list[int]]]:
    """(curve, source, block, numbers) of all steps that the wanted curves need and the columns lack, in order, each once."""
    have, steps = set(columns), []
    for curve in curves:
        parts = curve.split("|")
        at = max((i for i in range(1, len(parts) + 1) if "|".join(parts[:i]) in have), default=0)
        if not at:
            raise KeyError(f"no column to start {curve} from")
        for i in range(at, len(parts)):
            name, *numbers = parts[i].split("-")
            if name not in BLOCKS:
                raise KeyError(f"unknown block {name}")
            done = "|".join(parts[: i + 1])
            if done not in have:
                steps.append((done, "|".join(parts[:i]), name, [int(n) for n in numbers]))
                have.add(done)
    return steps


def with_curves(df: DataFrame, curves: list[str], series=SERIES) -> DataFrame:
    """`df` with all curves of `curves` that it lacks; steps whose rows lie near share one pass over blocks of a series."""
    steps = missing(df.columns, curves)
    if not steps:
        return df
    before = sum(BLOCKS[name][0](*numbers) for _, _, name, numbers in steps)

    def add(rows: DataFrame, key) -> DataFrame:
        for done, source, name, numbers in steps:
            rows = rows.withColumn("__x", F.col(f"`{source}`")).withColumn(done, BLOCKS[name][1]("__x", key, *numbers))
        return rows.drop("__x")

    return near(df, add, before, series=series)


def piped(df: DataFrame, *functions: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`df` through functions of a DataFrame, one after another."""
    for fn in functions:
        df = df.transform(fn)
    return df
