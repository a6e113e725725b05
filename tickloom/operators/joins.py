"""Joins along time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.windows import block_plan, carried, hour_of


def outer_on_ts(parts: dict[str, DataFrame], value: str) -> DataFrame:
    """Full outer join of many series on ts: one union and one pivot instead of a chain of joins."""
    long = None
    for name, df in parts.items():
        rows = df.select("ts", F.lit(name).alias("name"), F.col(value).alias("v"))
        long = rows if long is None else long.unionByName(rows)
    return long.groupBy("ts").pivot("name", list(parts)).agg(F.first("v"))


def common_ts(df: DataFrame, by: str) -> DataFrame:
    """Timestamps that every value of `by` has."""
    every = df.agg(F.count_distinct(by).alias("__n"))  # one row
    return df.groupBy("ts").agg(F.count_distinct(by).alias("n")).join(F.broadcast(every), F.col("n") == F.col("__n")).select("ts")


def asof(left: DataFrame, right: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Each left row with the latest right row at or before it (the later `seq` on equal ts).

    A union and what each day carries on: no range join, and no window over a whole series. Right rows sort before left
    rows of the same ts.
    """
    r = right.groupBy(*by, "ts").agg(F.max_by(F.struct(*columns), "seq").alias("__r"))
    names = left.columns
    both = left.withColumn("__o", F.lit(1)).unionByName(r.withColumn("__o", F.lit(0)), allowMissingColumns=True)
    out = carried(both, {"__m": ("last", F.col("__r"))}, series=tuple(by), order=("ts", "__o")).where("__o = 1")
    return out.select(*names, *[F.col(f"__m.{c}").alias(c) for c in columns])


def interval_bin(rows: DataFrame, ends: DataFrame, by: list[str], label: str) -> DataFrame:
    """The label of the interval (previous end, end] that holds each row, the least of those with the same end; rows after the last end
    are left out."""
    e = ends.select(*by, "ts", F.col(label).alias("__l")).withColumn("__o", F.lit(1))
    both = rows.withColumn("__o", F.lit(0)).unionByName(e, allowMissingColumns=True)
    out = carried(both, {label: ("next", F.col("__l"))}, series=tuple(by), order=("ts", "__o", "__l"))
    return out.where(F.col("__o") == 0).where(F.col(label).isNotNull()).select(*rows.columns, label)


def pad_missing(quotes: DataFrame, trades: DataFrame, by: list[str]) -> DataFrame:
    """Quotes, and the timestamps of trades that have none."""
    lacking = trades.select(*by, "ts").distinct().join(quotes, [*by, "ts"], "left_anti")
    return quotes.unionByName(lacking, allowMissingColumns=True)


def first_touch(entries: DataFrame, curve: DataFrame, by: list[str], value: str) -> DataFrame:
    """For each entry (id, series, ts, end, level, up) the first curve row in (ts, end] whose value is at `level` or beyond it
    (above if `up`, else below); null where there is none.

    The curve is cut into blocks of rows. The extremes of the blocks tell in which one a touch can be: the entry's own or the
    first later one that reaches the level. Only these are searched, by doubling maxima, so the work of an entry is one
    row for each hour of its window and log2 of a block's rows, however dense the curve is.
    """
    import numpy as np
    import pandas as pd

    plan = block_plan(curve, series=tuple(by)).drop("__own")
    placed = curve.withColumn("__c", hour_of("ts")).join(plan, [*by, "__c"]).drop("__c")
    tops = placed.groupBy(*by, "__block").agg(F.max(value).alias("__top"), F.min(value).alias("__low"))
    hours = F.explode(F.sequence(hour_of("ts"), hour_of("end"))).alias("__c")
    reach = F.when(F.col("up"), F.col("__top") >= F.col("level")).otherwise(F.col("__low") <= F.col("level"))
    met = entries.select("id", *by, "level", "up", hours).join(plan, [*by, "__c"]).select("id", *by, "level", "up", "__block").distinct()
    met = met.join(tops, [*by, "__block"]).where(reach).groupBy("id").agg(F.slice(F.array_sort(F.collect_set("__block")), 1, 2).alias("__at"))
    wanted = entries.join(met, "id").select("id", *by, F.col("ts").alias("from"), "end", F.col("level").cast("double").alias("level"), "up", F.explode("__at").alias("__block"))

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["ts", "seq"])
        ts, x, n = right["ts"].to_numpy(), right["x"].to_numpy(dtype=float), len(right)
        start = np.searchsorted(ts, left["from"].to_numpy(), side="right")
        up, level, found = left["up"].to_numpy(dtype=bool), left["level"].to_numpy(dtype=float), np.full(len(left), n)
        for side in (up, ~up):
            if not side.any() or not n:
                continue
            sign = 1.0 if side is up else -1.0
            tops = [np.where(np.isnan(x), -np.inf, sign * x)]
            while 1 << len(tops) <= n:
                last, k = tops[-1], 1 << (len(tops) - 1)
                tops.append(np.maximum(last, np.append(last[k:], np.full(k, -np.inf))))
            at, goal = start[side].copy(), sign * level[side]
            for k in range(len(tops) - 1, -1, -1):
                inside = at < n
                skip = inside & (tops[k][np.minimum(at, n - 1)] < goal)
                at = np.where(skip, at + (1 << k), at)
            found[side] = np.minimum(at, n)
        hit = found < n
        out = pd.DataFrame({"id": left["id"].to_numpy()[hit], "touch_ts": ts[found[hit]], "touch_seq": right["seq"].to_numpy()[found[hit]]})
        return out[out["touch_ts"].to_numpy() <= left["end"].to_numpy()[hit]]

    rows = placed.select(*by, "__block", "ts", "seq", F.col(value).cast("double").alias("x"))
    rows = rows.toDF(*rows.columns)  # names of its own: both sides may come from one table
    kind = dict(entries.dtypes)["id"]
    hits = wanted.groupBy(*by, "__block").cogroup(rows.groupBy(*by, "__block")).applyInPandas(search, f"id {kind}, touch_ts timestamp, touch_seq long")
    first = hits.groupBy("id").agg(F.min(F.struct("touch_ts", "touch_seq")).alias("__h")).select("id", "__h.*")
    return entries.join(first, "id", "left")


def score_distinct(df: DataFrame, features: list[str], score: Column, name: str = "score") -> DataFrame:
    """Score each distinct feature row once and join the scores back, null-safe."""
    states = df.select(*features).distinct().select(*[F.col(c).alias(f"__{c}") for c in features], score.alias(name))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in features]
    return df.join(states, on, "left").drop(*[f"__{c}" for c in features])


def aligned(parts: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Rows of many curves on the keys they share, with each part's number of rows; equal where no curve lacks a key. One union, one aggregation.

    A key must be unique in each part: `ok` is false where one repeats.
    """
    out, aggs = None, []
    for name, df in parts.items():
        rows = df.select(*by, F.lit(name).alias("__p"), F.struct(*[c for c in df.columns if c not in by]).alias(f"__{name}"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        aggs.append(F.first(f"__{name}", ignorenulls=True).alias(f"__{name}"))
    joined = out.groupBy(*by).agg(F.count_distinct("__p").alias("__n"), F.count(F.lit(1)).alias("__m"), *aggs).where(F.col("__n") == len(parts))
    cols = [F.col(f"__{name}.{c}").alias(c) for name, df in parts.items() for c in df.columns if c not in by]
    return joined.select(*by, *cols, (F.col("__m") == len(parts)).alias("ok"))


def stored_or(rows: DataFrame, stored: DataFrame, by: list[str], value: str, compute) -> DataFrame:
    """Rows with their stored value; `compute` (a function of a DataFrame) scores only the rows that have none."""
    known = rows.join(stored.select(*by, value), by).withColumn("stored", F.lit(True))
    return known.unionByName(compute(rows.join(stored, by, "left_anti")).withColumn("stored", F.lit(False)))
