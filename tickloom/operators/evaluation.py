"""Rewards, weights, column filters, model evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.recurrences import scan
from tickloom.operators.windows import SERIES, near_frames


def horizon(decay: float, least: float) -> int:
    """Number of powers of `decay` (from 1) above `least`."""
    if not 0 < decay < 1:
        raise ValueError("decay must be between 0 and 1")
    n, x = 0, 1.0
    while x > least:
        n, x = n + 1, x * decay
    return n


def with_discounted_reward(df: DataFrame, entry: str, exit_: str, decay: float, least: float, name: str = "reward", series=SERIES, rows: int = 0) -> DataFrame:
    """Millionths: mean over the horizon of decay^i * (entry_(t+i) - exit_t) / entry_t; fewer terms at the tail, same divisor.

    The sum is separable: what a suffix scan holds at a row, less what it holds n rows on, decayed n times. A row costs the same for any
    horizon. A null entry adds no term but takes its place.
    """
    n = horizon(decay, least)

    def reward(columns, own):
        e, x = columns
        there = ~np.isnan(e)
        back = lambda v: scan(decay, v[::-1], 0.0)[::-1]
        base = e[there][0] if there.any() else 0.0  # sums of differences keep more digits than differences of sums
        value, weight = back(np.where(there, e - base, 0.0)), back(there.astype(float))
        far = lambda v: v - decay**n * np.append(v[n:], np.zeros(min(n, len(v))))
        with np.errstate(divide="ignore", invalid="ignore"):
            return [(far(value) - (x - base) * far(weight)) / e * 1e6 / n]

    return near_frames(df, reward, f"{name} double", [entry, exit_], 0, n - 1, series, rows=rows)


def attribution_weights(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Absolute z-score of the label by its maximum, population deviation; 0 where all labels are equal."""
    stats = df.groupBy(*by).agg(F.avg(label).alias("__m"), F.stddev_pop(label).alias("__s"), F.min(label).alias("__a"), F.max(label).alias("__z"))
    most = F.greatest(F.col("__z") - F.col("__m"), F.col("__m") - F.col("__a"))
    weight = F.coalesce(F.abs(F.col(label) - F.col("__m")) / F.nullif(most, F.lit(0.0)), F.lit(0.0))
    return df.join(stats, by).withColumn("weight", weight).drop("__m", "__s", "__a", "__z")


def combined_weights(df: DataFrame, weights: list[str], by: list[str]) -> DataFrame:
    """Geometric and arithmetic mean of several weights, each by its maximum."""
    n = len(weights)
    geo = F.exp(sum((F.log(w) for w in weights[1:]), F.log(weights[0])) / n)
    ari = sum((F.col(w) for w in weights[1:]), F.col(weights[0])) / n
    rows = df.withColumns({"__g": geo, "__a": ari})
    top = rows.groupBy(*by).agg(F.max("__g").alias("__gm"), F.max("__a").alias("__am"))
    out = rows.join(top, by).withColumns({"geometric": F.col("__g") / F.col("__gm"), "arithmetic": F.col("__a") / F.col("__am")})
    return out.drop("__g", "__a", "__gm", "__am")


def rolling_splits(df: DataFrame, by: list[str], folds: int, ratio: int) -> DataFrame:
    """Bounds of rolling train/test splits per series: batches of n // folds rows, the last batch // ratio of them for test."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("batch", F.floor(F.col("n") / folds)).withColumn("test", F.greatest(F.floor(F.col("batch") / ratio), F.lit(1)))
    last = F.col("n") - F.col("batch") + F.col("n") % folds - 1
    z = n.where(last >= 0).select("*", F.explode(F.expr(f"sequence(0L, n - batch + n % {folds} - 1, test)")).alias("start"))
    middle = F.col("start") + F.col("batch") - F.col("test")
    end = F.when(F.col("start") >= F.col("n") - F.col("batch") - F.col("test"), F.col("n")).otherwise(F.col("start") + F.col("batch"))
    return z.select(*by, "start", middle.alias("test_start"), end.alias("test_end"))


def weighted_f1(df: DataFrame, side: Column, label: Column, returns: Column) -> DataFrame:
    """F1 in which hits weigh their gain and wrong sides that still made money are left out.

    `label` and `returns` are growth factors around 1. Longs (side 1) below 1 cost 2 - label, shorts (-1) above 1 cost label,
    every missed row (side 0) costs label.
    """
    gain = F.when(side > 0, label - returns).when(side < 0, returns - label)
    tp = F.sum(F.when(gain > 0, 1 + gain).otherwise(0.0))
    fp = F.sum(F.when((side > 0) & (label < 1), 2 - label).when((side < 0) & (label > 1), label).otherwise(0.0))
    fn = F.sum(F.when(side == 0, label).otherwise(0.0))
    sums = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return sums.withColumn("f1", F.col("tp") / (F.col("tp") + 0.5 * (F.col("fp") + F.col("fn"))))


def class_f1(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Precision, recall and F1 of each class in one aggregation."""
    pairs = df.groupBy(F.col(predicted).alias("p"), F.col(actual).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("p").alias("label"), F.when(F.col("p") == F.col("a"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("np"), F.lit(0).cast("long").alias("na")),
        F.struct(F.col("a").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("np"), F.col("n").alias("na")),
    )).alias("x")).select("x.*").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "np", "na")])
    return sides.select("label", (F.col("tp") / F.nullif("np", F.lit(0))).alias("precision"), (F.col("tp") / F.nullif("na", F.lit(0))).alias("recall"), (2 * F.col("tp") / (F.col("np") + F.col("na"))).alias("f1"))


def classifier_scores(df: DataFrame, actual: str, predicted: str, by: list[str], order: list[str]) -> DataFrame:
    """Counts of predictions, accuracy, precision, recall, F1, and the precision of first predictions: those that follow no other
    in the order inside a part (`by`). One window over parts and one aggregation."""
    from pyspark.sql import Window

    y, hit = F.col(actual), F.col(predicted)
    before = F.coalesce(F.lag(predicted).over(Window.partitionBy(*by).orderBy(*order)), F.lit(False))
    n = {"tp": y & hit, "fp": ~y & hit, "fn": y & ~hit, "tn": ~y & ~hit, "ff": hit & ~F.col("__b"), "ftp": y & hit & ~F.col("__b")}
    s = df.withColumn("__b", before).agg(*[F.count_if(test).alias(k) for k, test in n.items()])
    share = lambda a, b: a / F.nullif(b, F.lit(0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return s.select(
        (tp + fp).alias("positives"), (fn + tn).alias("negatives"), share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), F.col("ff").alias("first_positives"), share(F.col("ftp"), F.col("ff")).alias("first_precision"),
    )


def low_variance(long: DataFrame, feature: str, value: str) -> DataFrame:
    """Features (long form) with their variance; kept where it is half the median variance or more."""
    var = long.groupBy(feature).agg(F.var_samp(value).alias("variance"))
    mid = var.agg((F.percentile("variance", 0.5) / 2).alias("__m"))
    return var.join(F.broadcast(mid), F.lit(True)).withColumn("kept", F.col("variance") >= F.col("__m")).drop("__m")


def coverage(indexed: DataFrame, feature: list[str], ix: str, value: str) -> DataFrame:
    """Rows between the first and the last value of each feature; kept where that is the mean of all features or more."""
    at = F.when(F.col(value).isNotNull(), F.col(ix))
    span = indexed.groupBy(*feature).agg(F.coalesce(F.max(at) - F.min(at), F.lit(0)).alias("span"))
    mid = span.agg(F.avg("span").alias("__m"))
    return span.join(F.broadcast(mid), F.lit(True)).withColumn("kept", F.col("span") >= F.col("__m")).drop("__m")


def dickey_fuller(df: DataFrame, by: list[str], change: str, before: str, critical: float = -2.86) -> DataFrame:
    """t statistic of the level in change ~ 1 + level (no further lags) against the 5 % critical value with a constant."""
    s = df.groupBy(*by).agg(F.regr_slope(change, before).alias("slope"), F.regr_sxx(change, before).alias("sxx"), F.regr_syy(change, before).alias("syy"), F.regr_count(change, before).alias("n"))
    rest = (F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")) / (F.col("n") - 2)
    t = F.col("slope") / F.sqrt(rest / F.col("sxx"))
    return s.select(*by, t.alias("t"), (t <= critical).alias("stationary"))


def out_of_fold(df: DataFrame, estimator, folds: Column, k: int) -> DataFrame:
    """Out-of-fold predictions: one fit for each of k folds on the other folds; every row is predicted once, by the model that has not
    seen it. `estimator` is any pyspark.ml estimator; only models pass through the driver."""
    rows = df.withColumn("fold", folds)
    out = None
    for i in range(k):
        model = estimator.fit(rows.where(F.col("fold") != i))
        part = model.transform(rows.where(F.col("fold") == i))
        out = part if out is None else out.unionByName(part)
    return out


def clusters_by_k(df: DataFrame, features: str, ks: list[int], seed: int = 7) -> DataFrame:
    """Inertia and silhouette of k-means for each k, one row each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = []
    score = ClusteringEvaluator(featuresCol=features)
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol=features).fit(df)
        rows.append((k, float(model.summary.trainingCost), float(score.evaluate(model.transform(df)))))
    out = df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")
    return out


def cluster_weights(clustered: DataFrame, cluster: str = "prediction") -> DataFrame:
    """Inverse cluster size by the largest inverse: the smallest cluster weighs 1."""
    sizes = clustered.groupBy(cluster).agg(F.count(F.lit(1)).alias("__n"))
    least = sizes.agg(F.min("__n").alias("__l"))
    small = sizes.join(F.broadcast(least), F.lit(True))
    return clustered.join(F.broadcast(small), cluster).withColumn("weight", F.col("__l") / F.col("__n")).drop("__n", "__l")
