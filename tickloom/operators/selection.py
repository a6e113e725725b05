"""Screens of symbols, features and rows: summaries, percentile searches, importances, samples, chunk orders, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.windows import SERIES, carried


def summaries(df: DataFrame, price: str, by: list[str], order: list[str], compat: bool = False) -> DataFrame:
    """Per series: leading nulls, return, r2 against a straight line, Sharpe and Sortino ratio of steps relative to the last price.

    Both ratios are mean by population deviation by sqrt(rows); the first row's step is 0. The Sortino steps keep losses;
    with `compat` they keep gains. Null prices take part in no step; a ratio without deviation is null.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__i", F.row_number().over(w)).where(F.col(price).isNotNull())
    rows = rows.withColumn("__d", F.coalesce(F.col(price) - F.lag(price).over(w), F.lit(0.0)))
    rows = rows.withColumn("__s", F.greatest("__d", F.lit(0.0)) if compat else F.least("__d", F.lit(0.0)))
    first, last = F.min_by(price, "__i"), F.max_by(price, "__i")
    ratio = lambda c: F.avg(c) / F.nullif(F.stddev_pop(c), F.lit(0.0)) * F.sqrt(F.count(c)) * F.signum(last)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.min("__i") - 1).cast("long").alias("leading_nulls"), ((last - first) / first).alias("return"),
        F.pow(F.corr(price, "__i"), 2).alias("r2"), ratio("__d").alias("sharpe"), ratio("__s").alias("sortino"),
    )


def best_per_key(df: DataFrame, key: str, by: list[Column], screen: Column) -> DataFrame:
    """The greatest row of each key by `by`, if it passes the screen."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*by)).alias("__b"))
    return best.select(key, "__b.*").where(screen)


#: Value ranges that `percentiles` counts at once.
RANGES = 4096


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], ranges: int = RANGES) -> DataFrame:
    """by and `q`: the exact percentiles of each group, interpolated between ranks; nulls have no rank, a group of nulls has none.

    Rows are counted in equal ranges of a group's values, then in equal ranges of the ranges that hold a wanted rank, and only what is
    in one of those is put in order, as values with counts. No group's values are held or sorted, whatever their number.
    """
    keys, null_safe = [f"__g{i}" for i in range(len(by))] or ["__g"], [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by] or [F.lit("")]
    nulls = F.concat(F.lit(""), *[F.when(F.col(c).isNull(), "1").otherwise("0") for c in by])
    keys = [*keys, "__n"]
    rows = df.select(*by, *[c.alias(k) for c, k in zip([*null_safe, nulls], keys)], F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    ends = rows.groupBy(*by, *keys).agg(F.min("__v").alias("__a"), F.max("__v").alias("__z"), F.count(F.lit(1)).alias("__c"))
    width = lambda a, z, x: F.when(z > a, F.least(F.floor((x - a) / (z - a) * ranges), F.lit(ranges - 1))).otherwise(0).cast("int")
    inside = rows.drop(*by).join(ends.select(*keys, "__a", "__z"), keys).withColumn("__r1", width(F.col("__a"), F.col("__z"), F.col("__v")))

    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)])).alias("__p")
    at = ends.select(*by, *keys, "__c", place).withColumn("__at", (F.col("__c") - 1) * F.col("__p.s"))
    ranks = F.array_distinct(F.array(F.floor("__at").cast("long"), F.ceil("__at").cast("long")))
    wanted = at.select(*keys, F.explode(ranks).alias("__k")).distinct()

    def narrowed(wanted: DataFrame, rows: DataFrame, by_range: list[str], name: str) -> DataFrame:
        """The range that holds each rank, and its rank there; one row a range is put in order."""
        counts = rows.groupBy(*keys, *by_range, name).agg(F.count(F.lit(1)).alias("__in"))
        before = F.sum("__in").over(Window.partitionBy(*keys, *by_range).orderBy(name)) - F.col("__in")
        found = wanted.join(counts.withColumn("__before", before), [*keys, *by_range])
        rank = "__rank" if "__rank" in wanted.columns else "__k"
        found = found.where((F.col(rank) >= F.col("__before")) & (F.col(rank) < F.col("__before") + F.col("__in")))
        return found.withColumn("__rank", F.col(rank) - F.col("__before")).drop("__in", "__before")

    first = narrowed(wanted, inside, [], "__r1")
    some = inside.join(first.select(*keys, "__r1").distinct(), [*keys, "__r1"], "left_semi")
    span = some.groupBy(*keys, "__r1").agg(F.min("__v").alias("__a2"), F.max("__v").alias("__z2"))
    some = some.join(span, [*keys, "__r1"]).withColumn("__r2", width(F.col("__a2"), F.col("__z2"), F.col("__v")))
    second = narrowed(first, some, ["__r1"], "__r2")
    few = some.join(second.select(*keys, "__r1", "__r2").distinct(), [*keys, "__r1", "__r2"], "left_semi")
    last = narrowed(second, few, ["__r1", "__r2"], "__v").select(*keys, "__k", "__v")

    low, high = last.toDF(*keys, "__lo", "__x"), last.toDF(*keys, "__hi", "__y")
    both = at.withColumns({"__lo": F.floor("__at").cast("long"), "__hi": F.ceil("__at").cast("long")}).join(low, [*keys, "__lo"]).join(high, [*keys, "__hi"])
    q = F.col("__x") + (F.col("__y") - F.col("__x")) * (F.col("__at") - F.col("__lo"))
    made = both.select(*by, *keys, F.struct(F.col("__p.i").alias("i"), q.alias("q")).alias("__q"))
    return made.groupBy(*by, *keys).agg(F.transform(F.array_sort(F.collect_list("__q")), lambda x: x["q"]).alias("q")).drop(*keys)


def joint_percentile(df: DataFrame, columns: list[str], more_than: int) -> DataFrame:
    """The highest whole percentile above which more than `more_than` rows lie in every column at once; 1 if there is none.

    One row of 99 thresholds a column; each row then has the highest level it passes in all columns, and levels are counted.
    A z-score does not change the order of a column, so it changes no level.
    """
    cuts = None
    for c in columns:
        own = percentiles(df, [], c, [p / 100 for p in range(1, 100)]).withColumnRenamed("q", f"__{c}")
        cuts = own if cuts is None else cuts.crossJoin(own)  # one row each
    under = lambda c: F.filter(f"__{c}", lambda t: t < F.col(c))
    passed = [F.size(under(c)) for c in columns]
    level = F.least(*passed) if len(passed) > 1 else passed[0]
    levels = df.join(F.broadcast(cuts), F.lit(True)).select(level.alias("level")).where("level > 0").groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    above = levels.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("level"))))  # 99 rows at most
    return above.agg(F.coalesce(F.max(F.when(F.col("above") > more_than, F.col("level"))), F.lit(1)).cast("int").alias("level"))


def important(scores: DataFrame, model: str, feature: str, score: str, below: float, required: list[str]) -> DataFrame:
    """Every feature of any model, selected where a model's running score, best first, is under `below`, or where it is required."""
    w = Window.partitionBy(model).orderBy(F.desc(score), feature).rowsBetween(Window.unboundedPreceding, 0)
    seen = scores.withColumn("__s", F.sum(score).over(w) < below).groupBy(feature).agg(F.bool_or("__s").alias("selected"))
    must = scores.sparkSession.createDataFrame([(x,) for x in required], f"{feature} string").withColumn("__m", F.lit(True))
    return seen.join(F.broadcast(must), feature, "full").select(feature, F.coalesce("__m", "selected").alias("selected"))


def mean_importance(scores: DataFrame, model: str, feature: str, score: str, below: float) -> DataFrame:
    """Mean score of each feature as a share of all means, with the running share, best first; kept while that is under `below`."""
    models = scores.agg(F.count_distinct(model).alias("__n"))
    mean = scores.groupBy(feature).agg(F.sum(score).alias("__s")).join(F.broadcast(models), F.lit(True)).select(feature, (F.col("__s") / F.col("__n")).alias("__m"))
    share = mean.join(F.broadcast(mean.agg(F.sum("__m").alias("__t"))), F.lit(True)).select(feature, (F.col("__m") / F.col("__t")).alias("share"))
    out = share.withColumn("running", F.sum("share").over(Window.orderBy(F.desc("share"), feature).rowsBetween(Window.unboundedPreceding, 0)))  # one row a feature
    return out.withColumn("kept", F.col("running") < below)


def chunk_order(df: DataFrame, k: int, by=SERIES, order=("ts", "seq")) -> DataFrame:
    """A series in k * k consecutive chunks, the first ones a row longer; chunk i goes to place i // k + k * (i mod k).

    So each k-th of the new order has a chunk from the start, the middle and the end. `ix` is a row's old, `new_ix` its new position.
    """
    kk = k * k
    rows = carried(df, {"ix": ("sum", F.lit(1)), "__n": ("total", F.lit(1))}, series=tuple(by), order=tuple(order)).withColumn("ix", F.col("ix") - 1)
    size, more, ix = F.floor(F.col("__n") / kk), F.col("__n") % kk, F.col("ix")
    long = more * (size + 1)
    chunk = F.when(ix < long, F.floor(ix / (size + 1))).otherwise(more + F.floor((ix - long) / F.nullif(size, F.lit(0)))).cast("long")
    rows = rows.withColumns({"chunk": chunk})
    rows = rows.withColumn("place", (F.floor(F.col("chunk") / k) + k * (F.col("chunk") % k)).cast("long"))
    # Rows before a chunk's new place: those of the chunks put before it, of which some are a row longer.
    put = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(kk - 1).cast("long")), lambda q: q < F.col("place"))
    longer = F.size(F.filter(put, lambda q: (q % k) * k + F.floor(q / k) < more))
    first = F.col("chunk") * size + F.least(F.col("chunk"), more)
    return rows.withColumn("new_ix", (F.col("place") * size + longer + ix - first).cast("long")).drop("__n")


def sampled(df: DataFrame, key: Column, share: float, seed: str = "") -> DataFrame:
    """About `share` of the rows by md5 of seed and key: the same rows at any partitioning."""
    cut = f"{int(share * 16**8):08x}"
    return df.where(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8) < cut)


def same_columns(long: DataFrame, feature: str, row: str, value: str, least: float) -> DataFrame:
    """Features (long form) with their population variance and the first feature of equal values; kept where that is the feature itself and the
    variance is `least` or more. Equality is that of two order-free sums of 64-bit hashes."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), row, value).cast("decimal(38,0)"))
    s = long.groupBy(feature).agg(F.var_pop(value).alias("variance"), h(1).alias("__a"), h(2).alias("__b"))
    s = s.withColumn("same_as", F.min(feature).over(Window.partitionBy("__a", "__b"))).drop("__a", "__b")
    return s.withColumn("kept", (F.col("same_as") == F.col(feature)) & (F.col("variance") >= least))


def cut_where_many(df: DataFrame, columns: list[str], more_than: int, bins: int) -> DataFrame:
    """Columns with more than `more_than` distinct values (estimated, within 1 %) as equal-width bins, closed on the right; one pass for all columns."""
    stats = df.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("z"), F.approx_count_distinct(c, 0.01).alias("n")).alias(f"__{c}") for c in columns])
    cols = {}
    for c in columns:
        a, z, n = (F.col(f"__{c}.{x}") for x in "azn")
        code = F.greatest(F.least(F.ceil((F.col(c) - a) * bins / F.nullif(z - a, F.lit(0.0))) - 1, F.lit(bins - 1)), F.lit(0))
        cols[c] = F.when(n > more_than, F.coalesce(code, F.when(F.col(c).isNotNull(), 0)).cast("double")).otherwise(F.col(c))
    return df.join(F.broadcast(stats), F.lit(True)).withColumns(cols).select(df.columns)


def pairs_of(df: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """Rows (by, a, b, x, y) of every two names, in order, that share a key; one row for each pair and key, so `df` is to be bars."""
    left = df.select(*by, F.col(name).alias("a"), F.col(value).alias("x"))
    right = df.select(*by, F.col(name).alias("b"), F.col(value).alias("y"))
    return left.join(right, by).where(F.col("a") < F.col("b"))


def cointegration(df: DataFrame, a: str, b: str, by: list[str], order: list[str]) -> DataFrame:
    """Per pair: correlation and regression of a on b, and the t statistic of the residual's level in its change (no further lags).

    Second and later sums come from aggregates; rows are only put in order to take differences, so `df` is to be bars, not ticks.
    """
    from tickloom.operators.evaluation import dickey_fuller

    line = df.groupBy(*by).agg(F.corr(a, b).alias("corr"), F.regr_slope(a, b).alias("beta"), F.regr_intercept(a, b).alias("alpha"))
    rows = df.join(line, by).withColumn("__r", F.col(a) - F.col("alpha") - F.col("beta") * F.col(b))
    rows = rows.withColumn("__b", F.lag("__r").over(Window.partitionBy(*by).orderBy(*order))).withColumn("__c", F.col("__r") - F.col("__b"))
    return dickey_fuller(rows, [*by, "corr", "alpha", "beta"], "__c", "__b", -3.34)  # 5 % value of two series with a constant
