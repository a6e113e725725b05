"""Linear recurrences, and recurrences of recurrences, by blocks of a series.

A block turns the state that comes in into a linear map of it: what comes out of state 0, plus what each unit of state leaves with
nothing else added. So blocks are folded at the same time, one pass over a few numbers a block gives each the state that
comes in, and the blocks are then run once more with it. Inside a block a recurrence is a scan of doubling steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.windows import BLOCK_ROWS, ORDER, SERIES, _small_join, block_plan, fold_ordered, hour_of


def scan(a, b: np.ndarray, before: float) -> np.ndarray:
    """y_t = a_t * y_(t-1) + b_t, from y = `before`; `a` is a number or one for each row."""
    y, q, k = np.array(b, dtype=float), np.array(np.broadcast_to(a, len(b)), dtype=float), 1
    while k < len(y):
        y[k:] += q[k:] * y[:-k]
        q[k:] *= q[:-k].copy()
        k *= 2
    return y + q * before


def mean(x: np.ndarray, n: int, before: float | None, wilder: bool = False, start: int = 0) -> np.ndarray:
    """Exponential mean, a = 1 - 2 / (n + 1), or 1 - 1 / n with `wilder`.

    Where a series begins (`before` is None) it is the mean of the last n values (or as many as there are) at value `start` (n unless
    told otherwise) and nothing before that; values that are not there yet at the beginning do not count.
    """
    a = 1 - (1 / n if wilder else 2 / (n + 1))
    if before is not None:
        return scan(a, (1 - a) * x, before)
    out, first = np.full(len(x), np.nan), int(np.argmin(np.isnan(x))) if len(x) and not np.isnan(x).all() else len(x)
    at = first + (start or n) - 1
    if at < len(x):
        out[at] = x[max(first, at - n + 1) : at + 1].mean()
        out[at + 1 :] = scan(a, (1 - a) * x[at + 1 :], out[at])
    return out


def recurrence(df: DataFrame, inputs: list[str], made: list[str], run, size: int, least: int = 1, nulls: bool = False, series=SERIES, order=ORDER, rows: int = 0) -> DataFrame:
    """Double columns `made` of recurrences over the `inputs`, in parallel inside one series.

    `run(x, state, zero)` gives the columns (arrays, not a number for null) and the state at the end, of a block's inputs (arrays) and the
    state before it: `size` numbers, or None where a series begins. The state at the end must be a linear map of that before, plus
    what the inputs add; with `zero` they add nothing. `least`: rows from which on a series has begun, which no block but the last has
    less of. Rows with a null input are left out of it and get nulls, unless `nulls`: then they come as not a number.
    """
    import pickle

    import pandas as pd
    from pyspark.sql.types import DoubleType, StructType

    keys, columns = [*series, "__block"], df.columns
    whole = F.lit(True)
    for c in inputs:
        whole = whole & F.col(c).isNotNull()
    whole = F.lit(True) if nulls else whole
    own = df.where(whole)
    placed = _small_join(own.withColumn("__c", hour_of("ts")), block_plan(own, series=series, rows=max(rows or BLOCK_ROWS, least)).drop("__own"), [*series, "__c"]).drop("__c")
    of = placed.select(*keys).schema.fields

    def arrays(pdf: pd.DataFrame) -> list[np.ndarray]:
        return [pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in inputs]

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        x = arrays(pdf.sort_values(list(order)))
        if pdf["__block"].iloc[0] == 0:
            kept = (None, run(x, None, False)[1])
        else:
            units = [run(x, unit, True)[1] for unit in np.eye(size)]
            kept = (np.array(units, dtype=float).T, run(x, np.zeros(size), False)[1])
        return pdf[keys].head(1).assign(__state=pickle.dumps(kept))

    def step(state, row):
        known = state or (None,)
        by, add = pickle.loads(row[-1])
        return (np.array(add, dtype=float) if by is None else by @ known[0] + np.array(add, dtype=float),), (*row[:-1], pickle.dumps(known[0]))

    kept = StructType(of).add("__state", "binary")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    small = placed.select(*keys, *order, *[c for c in dict.fromkeys(inputs) if c not in (*keys, *order)])
    states = fold_ordered(small.groupBy(*keys).applyInPandas(summarise, kept), list(series), step, ddl, ("__block",))
    schema = StructType(list(df.schema.fields))
    for name in made:
        schema = schema.add(name, DoubleType())

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        out = run(arrays(pdf), pickle.loads(pdf["__state"].iloc[0]), False)[0]
        return pdf[columns].assign(**dict(zip(made, out)))

    done = _small_join(placed, states, keys).groupBy(*keys).applyInPandas(follow, schema)
    if nulls:
        return done
    none = df.where(~whole).select("*", *[F.lit(None).cast("double").alias(n) for n in made])
    return done.unionByName(none)
