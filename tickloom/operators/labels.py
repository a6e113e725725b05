"""Labels, event samples, weights and splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.searches import Tops, first_where
from tickloom.operators.windows import SERIES, carried, near, near_frames, ordered


def triple_barrier(df: DataFrame, price: str, vol: str, n: int, target: float, stop: float, series=SERIES, rows: int = 0) -> DataFrame:
    """-1, 0 or 1 over the next n rows; barriers 1 +- vol * factor are taken at each future row.

    Short wins if its target is touched before its stop and before the long target; long likewise; ties give 0.
    A touch at the entry row does not count. Rows without n rows ahead are dropped; null prices, prices that are not above 0 and null
    volatilities touch nothing. A row touches a barrier of an earlier one where price over barrier reaches the earlier price, so
    all rows of a block are searched at once in four curves that do not depend on them.
    """

    def label(columns, own):
        p, v = columns
        p = np.where(p > 0, p, np.nan)
        at = np.arange(len(p))
        end = np.minimum(at + n + 1, len(p))
        first = []
        with np.errstate(divide="ignore", invalid="ignore"):
            for factor, up in ((target, True), (-stop, False), (-target, False), (stop, True)):
                barrier = 1 + v * factor if factor >= 0 else 1 - v * -factor
                over = np.where(barrier > 0, p / barrier, np.inf * np.sign(p)) * (1 if up else -1)
                holds = lambda i, j, b=barrier, u=up: (p[j] / p[i] >= b[j]) if u else (p[j] / p[i] <= b[j])
                goal = p * (1 - 1e-12) if up else -p * (1 + 1e-12)
                first.append(first_where(Tops(over), at + 1, np.where(np.isnan(goal), np.inf, goal), end, holds))
        long_target, long_stop, short_target, short_stop = first
        out = np.where((short_target < short_stop) & (short_target < long_target), -1, np.where((long_target < long_stop) & (long_target < short_target), 1, 0)).astype(float)
        out[at + n >= len(p)] = np.nan
        return [out]

    made = near_frames(df, label, "label double", [price, vol], 0, n, series, rows=rows)
    return made.where(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("int"))


def changes(df: DataFrame, label: str = "label") -> DataFrame:
    before = lambda d, s: d.withColumn("__l", F.coalesce(F.lag(label).over(ordered(s)), F.lit(0)))
    return near(df, before, 1).where(F.col(label) != F.col("__l")).drop("__l")


def decayed_return(ret: str, span: int, series=SERIES) -> Column:
    """Product over the next `span` rows of 1 + ret * (1 - alpha)^i, alpha = 2 / (span + 1); null without all rows."""
    decay = 1 - 2 / (span + 1)
    w = ordered(series).rowsBetween(1, span)
    rows = F.collect_list(ret).over(w)
    parts = F.transform(rows, lambda r, i: 1 + r * F.pow(F.lit(decay), i))
    return F.when(F.size(rows) == span, F.aggregate(parts, F.lit(1.0), lambda a, x: a * x))


def event_sample(df: DataFrame, value: str, k: float, most: int) -> DataFrame:
    """Rows beyond k sample deviations; none of a series that has more than `most` of them."""
    dev = df.groupBy("exchange", "symbol").agg(F.stddev_samp(value).alias("__sd"))
    hits = df.join(dev, list(SERIES)).where(F.abs(value) >= k * F.col("__sd")).drop("__sd")
    few = hits.groupBy("exchange", "symbol").count().where(F.col("count") <= most).select("exchange", "symbol")
    return hits.join(few, list(SERIES), "left_semi")


def indexed(df: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Row index `ix` from 0 and rows `n` of each series."""
    series = series or list(SERIES)
    rows = carried(df, {"ix": ("sum", F.lit(1)), "n": ("total", F.lit(1))}, series=tuple(series))
    return rows.withColumn("ix", F.col("ix") - 1)


def holdout(df: DataFrame, share: float = 0.3) -> DataFrame:
    """The last share of each series, by time, is held out."""
    return indexed(df).withColumn("held_out", F.col("ix") >= F.col("n") - F.floor(F.col("n") * share))


def purged_folds(df: DataFrame, k: int, purge: int) -> DataFrame:
    """(ix, fold, role): k contiguous folds, the first n mod k one longer; training rows near a fold are purged.

    A middle fold loses purge + 1 rows before it and purge after; an edge fold loses purge.
    """
    rows = indexed(df)
    fold = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    base, extra = F.floor(F.col("n") / k), F.col("n") % k
    begin = F.col("fold") * base + F.least(F.col("fold"), extra)
    end = begin + base + F.when(F.col("fold") < extra, 1).otherwise(0)
    out = rows.select("exchange", "symbol", "ix", "n", fold).withColumn("b", begin).withColumn("e", end)
    before = F.when((F.col("fold") > 0) & (F.col("fold") < k - 1), purge + 1).otherwise(purge)
    role = (
        F.when((F.col("ix") >= F.col("b")) & (F.col("ix") < F.col("e")), "test")
        .when((F.col("ix") < F.col("b")) & (F.col("ix") >= F.col("b") - before), "purged")
        .when((F.col("ix") >= F.col("e")) & (F.col("ix") < F.col("e") + purge), "purged")
        .otherwise("train")
    )
    return out.select("exchange", "symbol", "ix", "fold", role.alias("role"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weights by class: flat rows sum to 0.5, long and short rows to 0.25 each."""
    n = df.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    rows = df.join(n, F.col(label).eqNullSafe(F.col("__l")))
    return rows.withColumn("weight", F.when(F.col(label) == 0, 0.5).otherwise(0.25) / F.col("__n")).drop("__l", "__n")


def pinball(y: Column, p: Column, q: float) -> Column:
    return F.greatest(q * (y - p), (q - 1) * (y - p))
