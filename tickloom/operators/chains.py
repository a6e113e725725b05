"""Chains of rows: where each row has one next row, the rows that follow from the first one, without a task that holds a series.

What is kept after a row depends on that row only (a restart, the last value kept, the end of what was taken), so every row has one next
row and the rows kept are one path. A series is cut into blocks of whole hours:

1. In each block, next rows inside of it come from prefix sums, doubled extremes or a search in time, and doubling the pointers gives the
   last row of the path from every row. A block's summary says what it makes of any state that comes in: which rows can be the
   first ones, and what each leads to at the block's end.
2. One pass over the summaries of a series (a row a block, in order) gives each block the state that comes in.
3. Each block follows its own part of the path.

A summary holds the rows that can come first only: those up to the first restart, the new extremes, or a number for each
different end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.windows import SERIES, _small_join, block_plan, fold_ordered, hour_of


def last_rows(following: np.ndarray) -> np.ndarray:
    """The last row of the path from each row; `following` holds later rows, or the number of rows where there is none."""
    at = np.arange(len(following))
    to = np.where(following < len(following), following, at)
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


def path(following: np.ndarray, first: int) -> list[int]:
    out = []
    while first < len(following):
        out.append(first)
        first = int(following[first])
    return out


class Runs:
    """Two one-sided sums that restart where one of them reaches the unit; `measure` and `unit` are whole numbers."""

    def __init__(self, measure: list[int], unit: int):
        kind = np.int64 if sum(map(abs, measure)) + unit < 1 << 62 else object
        self.unit = unit
        self.plus = np.cumsum(np.array([max(m, 0) for m in measure], dtype=kind))
        self.minus = np.cumsum(np.array([max(-m, 0) for m in measure], dtype=kind))
        self.following = np.minimum(np.searchsorted(self.plus, self.plus + unit), np.searchsorted(self.minus, self.minus + unit))

    @staticmethod
    def first(plus, minus, unit: int, state) -> int:
        up, down = state or (0, 0)
        return int(min(np.searchsorted(plus, unit - up), np.searchsorted(minus, unit - down)))

    def summary(self):
        last = last_rows(self.following)
        n = self.first(self.plus, self.minus, self.unit, None) + 1
        left = (self.plus[-1] - self.plus[last[:n]], self.minus[-1] - self.minus[last[:n]])
        return self.unit, self.plus[:n], self.minus[:n], left, (int(self.plus[-1]), int(self.minus[-1]))

    @classmethod
    def after(cls, summary, state):
        unit, plus, minus, left, total = summary
        k = cls.first(plus, minus, unit, state)
        if k < len(plus):
            return int(left[0][k]), int(left[1][k])
        return tuple(a + b for a, b in zip(state or (0, 0), total))

    def kept(self, state) -> tuple[list[int], list[int]]:
        """Rows that reach the unit, and the side of each."""
        rows, sides = path(self.following, self.first(self.plus, self.minus, self.unit, state)), []
        before = (state or (0, 0))[0]
        for k in rows:
            sides.append(1 if before + int(self.plus[k]) >= self.unit else -1)
            before = -int(self.plus[k])
        return rows, sides


class Drift:
    """Values that are `delta` or more from the last one kept; the first one is kept."""

    def __init__(self, values: np.ndarray, delta: float):
        self.x, self.delta, n = values, delta, len(values)
        tops, lows = [values], [values]
        while 1 << len(tops) <= n:  # extremes of the 2^k values from each one on
            k = 1 << (len(tops) - 1)
            tops.append(np.maximum(tops[-1], np.append(tops[-1][k:], np.full(min(k, n), -np.inf))))
            lows.append(np.minimum(lows[-1], np.append(lows[-1][k:], np.full(min(k, n), np.inf))))
        at = np.arange(1, n + 1)
        for k in range(len(tops) - 1, -1, -1):
            inside = np.minimum(at, n - 1)
            skip = (at < n) & ~(tops[k][inside] - values >= delta) & ~(values - lows[k][inside] >= delta)
            at = np.where(skip, np.minimum(at + (1 << k), n), at)
        self.following = at

    def summary(self):
        end = self.x[last_rows(self.following)]
        records = [np.flatnonzero(np.append(True, best[1:] != best[:-1])) for best in (np.maximum.accumulate(self.x), np.minimum.accumulate(self.x))]
        return self.delta, [(r, self.x[r], end[r]) for r in records]

    @staticmethod
    def after(summary, state):
        delta, ((high, tops, after_high), (low, lows, after_low)) = summary
        if state is None:
            return float(after_high[0])
        found = [(int(at[k]), float(to[k])) for at, far, to in ((high, tops - state, after_high), (low, state - lows, after_low)) for k in np.flatnonzero(far >= delta)[:1]]
        return min(found)[1] if found else state

    def kept(self, state) -> tuple[list[int], list[float]]:
        away = np.arange(len(self.x)) if state is None else np.flatnonzero(np.abs(self.x - state) >= self.delta)
        rows = path(self.following, int(away[0]) if len(away) else len(self.x))
        return rows, self.x[rows].tolist()


class Turns:
    """Rows that start after the end of the last row taken; times are whole numbers."""

    def __init__(self, start: np.ndarray, end: np.ndarray):
        self.start, self.end = start, end
        self.following = np.maximum(np.searchsorted(start, end, side="right"), np.arange(len(start)) + 1)

    def summary(self):
        free = self.end[last_rows(self.following)]
        ends = np.append(free[1:] != free[:-1], True)  # the last row of those that lead to one end
        return self.start[ends], free[ends]

    @staticmethod
    def after(summary, state):
        start, free = summary
        k = 0 if state is None else int(np.searchsorted(start, state, side="right"))
        return int(free[k]) if k < len(free) else state

    def kept(self, state) -> tuple[list[int], list[int]]:
        rows = path(self.following, 0 if state is None else int(np.searchsorted(self.start, state, side="right")))
        return rows, self.end[rows].tolist()


def block_states(df: DataFrame, summarise, after, series=SERIES, order=("ts", "seq"), rows: int = 0) -> tuple[DataFrame, DataFrame, list[str]]:
    """The rows of `df` with their block, the state (`__state`, pickled) that comes into each block, and the keys of a block.

    `summarise(rows)` gives what a block (a sorted pandas frame) does to any state; `after(summary, state)` the state after it (None before
    the first block). Only summaries are taken in order.
    """
    import pickle

    import pandas as pd
    from pyspark.sql.types import StructType

    keys = [*series, "__block"]
    placed = _small_join(df.withColumn("__c", hour_of("ts")), block_plan(df, series=series, rows=rows).drop("__own"), [*series, "__c"]).drop("__c")
    of = placed.select(*keys).schema.fields

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[keys].head(1).assign(__state=pickle.dumps(summarise(pdf.sort_values(list(order)))))

    def step(state, row):
        known = state or (None,)
        return (after(pickle.loads(row[-1]), known[0]),), (*row[:-1], pickle.dumps(known[0]))

    kept = StructType(of).add("__state", "binary")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    return placed, fold_ordered(placed.groupBy(*keys).applyInPandas(summary, kept), list(series), step, ddl, ("__block",)), keys


def folded(df: DataFrame, summarise, after, run, schema, series=SERIES, order=("ts", "seq"), rows: int = 0) -> DataFrame:
    """An ordered fold over each series in parallel blocks of whole hours: `block_states`, and `run(rows, state)` gives the block's output,
    of `schema`. For small states and outputs: every row has its block's state, and a block's output is one frame."""
    import pickle

    import pandas as pd

    placed, states, keys = block_states(df, summarise, after, series, order, rows)

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        return run(pdf, pickle.loads(pdf["__state"].iloc[0]))

    return _small_join(placed, states, keys).groupBy(*keys).applyInPandas(follow, schema)


def chain(df: DataFrame, make, value: str, series=SERIES, order=("ts", "seq"), rows: int = 0) -> DataFrame:
    """The rows of `df` on each series' path, with the column `value` (name and type) that the chain gives them.

    `make(rows)` gives a chain such as those above, of the sorted rows of a block (a pandas frame); `rows`: of a block, about.
    """
    from pyspark.sql.types import StructType

    columns, name = df.columns, value.split()[0]

    def run(pdf, state):
        at, values = make(pdf).kept(state)
        return pdf.iloc[at][columns].assign(**{name: values})

    schema = StructType(df.schema.fields + StructType.fromDDL(value).fields)
    return folded(df, lambda pdf: make(pdf).summary(), make.after, run, schema, series, order, rows)
