"""Queries over rewards, weights, splits, models, column filters and gapless volume bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import views
from tickloom.operators import bars, evaluation, joins, labels, padding, selection, windows
from tickloom.operators.windows import ordered
from tickloom.plans.registry import query, rounded, table_query

W = "PARTITION BY exchange, symbol ORDER BY ts, seq"
_N = evaluation.horizon(0.9, 0.05)


@query("l04_discounted_reward", "quotes", f"""WITH a AS (SELECT exchange, symbol, ts, seq, CAST(bid AS DOUBLE) AS b, CAST(ask AS DOUBLE) AS k, list(CAST(bid AS DOUBLE)) OVER ({W} ROWS BETWEEN CURRENT ROW AND {_N - 1} FOLLOWING) AS xs FROM quotes)
SELECT exchange, symbol, ts, seq, round(list_sum(list_transform(xs, lambda x, i: power(0.9, i - 1) * (x - k) / b)) * 1e6 / {_N}, 4) + 0.0 AS reward FROM a""")
def l04(q):
    x = q.withColumns({c: F.col(c).cast("double") for c in ("bid", "ask")})
    x = evaluation.with_discounted_reward(x, "bid", "ask", 0.9, 0.05)
    return x.select("exchange", "symbol", "ts", "seq", (F.round("reward", 4) + 0.0).alias("reward"))


@query("l06_attribution_weights", "ticks", """WITH m AS (SELECT exchange, symbol, avg(CAST(price AS DOUBLE)) AS m, max(CAST(price AS DOUBLE)) AS z, min(CAST(price AS DOUBLE)) AS a FROM ticks GROUP BY exchange, symbol)
SELECT exchange, symbol, ts, seq, round(abs(CAST(price AS DOUBLE) - m) / greatest(z - m, m - a), 6) + 0.0 AS weight FROM ticks JOIN m USING (exchange, symbol)""")
def l06(t):
    x = t.select("exchange", "symbol", "ts", "seq", F.col("price").cast("double").alias("p"))
    return rounded(evaluation.attribution_weights(x, "p", ["exchange", "symbol"]).drop("p"))


@table_query("l07_cluster_weights")
def l07(spark, sf_dir):
    return rounded(evaluation.cluster_weights(_clustered(spark, sf_dir)).select("vec_id", "weight"))


def _vectors(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", array_to_vector("embedding").alias("features"))


def _clustered(spark, sf_dir):
    from pyspark.ml.clustering import KMeans

    v = _vectors(spark, sf_dir)
    return KMeans(k=8, seed=7).fit(v).transform(v)


@query("l09_combined_weights", "ticks", """WITH a AS (SELECT exchange, symbol, ts, seq, exp((ln(CAST(price AS DOUBLE)) + ln(CAST(size AS DOUBLE))) / 2) AS g, (CAST(price AS DOUBLE) + CAST(size AS DOUBLE)) / 2 AS a FROM ticks)
SELECT exchange, symbol, ts, seq, round(g / max(g) OVER (PARTITION BY exchange, symbol), 6) AS geometric, round(a / max(a) OVER (PARTITION BY exchange, symbol), 6) AS arithmetic FROM a""")
def l09(t):
    x = t.select("exchange", "symbol", "ts", "seq", F.col("price").cast("double").alias("a"), F.col("size").cast("double").alias("b"))
    return rounded(evaluation.combined_weights(x, ["a", "b"], ["exchange", "symbol"]).drop("a", "b"))


@query("l12_rolling_splits", "ticks", """WITH n AS (SELECT exchange, symbol, count(*) AS n FROM ticks GROUP BY exchange, symbol), b AS (SELECT *, n // 3 AS batch, greatest((n // 3) // 3, 1) AS test FROM n),
z AS (SELECT *, unnest(range(0, n - batch + n % 3, test)) AS start FROM b)
SELECT exchange, symbol, start, start + batch - test AS test_start, CASE WHEN start >= n - batch - test THEN n ELSE start + batch END AS test_end FROM z""")
def l12(t):
    return evaluation.rolling_splits(t, ["exchange", "symbol"], 3, 3)


def _lagged(t):
    """Returns of the last rows as features, the next return as label."""
    from pyspark.ml.feature import VectorAssembler

    p = F.col("price").cast("double")

    def returns(d, s):
        w = ordered(s)
        return d.withColumns({f"r{n}": p / F.lag(p, n).over(w) - 1 for n in (1, 2, 5)} | {"label": F.lead(p).over(w) / p - 1})

    x = windows.near(t, returns, 5, 1).select("exchange", "symbol", "ts", "seq", "r1", "r2", "r5", "label")
    return VectorAssembler(inputCols=["r1", "r2", "r5"], outputCol="features").transform(x.dropna())


@query("l14_out_of_fold", "ticks")
def l14(t):
    """Three folds of days; each is scored by trees fitted on the others (U01), averaged per ts."""
    from pyspark.ml.regression import GBTRegressor

    x = _lagged(t)
    scored = evaluation.out_of_fold(x, GBTRegressor(maxIter=4, maxDepth=3, seed=7), F.pmod(F.datediff(F.to_date("ts"), F.lit("2000-01-01")), F.lit(3)), 3)
    return rounded(scored.groupBy("exchange", "symbol", "ts").agg(F.avg("prediction").alias("prediction"), F.count(F.lit(1)).alias("n")))


@table_query("l15_clusters_by_k")
def l15(spark, sf_dir):
    return rounded(evaluation.clusters_by_k(_vectors(spark, sf_dir), "features", [2, 4, 8]))


PRED = "SELECT CAST(round(value / 500) AS INT) AS p, CAST(event_type = 'purchase' AS INT) AS a FROM events"


@table_query("l17_class_f1", f"""WITH x AS ({PRED}), c AS (SELECT DISTINCT p AS label FROM x UNION SELECT DISTINCT a FROM x)
SELECT label, round(count(*) FILTER (p = label AND a = label) / nullif(count(*) FILTER (p = label), 0), 6) AS precision, round(count(*) FILTER (p = label AND a = label) / nullif(count(*) FILTER (a = label), 0), 6) AS recall,
round(2.0 * count(*) FILTER (p = label AND a = label) / (count(*) FILTER (p = label) + count(*) FILTER (a = label)), 6) AS f1 FROM x, c GROUP BY label""")
def l17(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    x = e.select(F.round(F.col("value") / 500).cast("int").alias("p"), (F.col("event_type") == "purchase").cast("int").alias("a"))
    return rounded(evaluation.class_f1(x, "p", "a"))


@query("l18_weighted_f1", "ticks", f"""WITH a AS (SELECT CAST(CASE WHEN size < 3 THEN 0 ELSE side END AS INT) AS s, CAST(price AS DOUBLE) / lag(CAST(price AS DOUBLE)) OVER ({W}) AS l FROM ticks),
b AS (SELECT *, CASE WHEN s > 0 THEN l - 1 WHEN s < 0 THEN 1 - l END AS g FROM a WHERE l IS NOT NULL),
c AS (SELECT sum(CASE WHEN g > 0 THEN 1 + g ELSE 0 END) AS tp, sum(CASE WHEN s > 0 AND l < 1 THEN 2 - l WHEN s < 0 AND l > 1 THEN l ELSE 0 END) AS fp, sum(CASE WHEN s = 0 THEN l ELSE 0 END) AS fn FROM b)
SELECT round(tp, 4) AS tp, round(fp, 4) AS fp, round(fn, 4) AS fn, round(tp / (tp + 0.5 * (fp + fn)), 6) AS f1 FROM c""")
def l18(t):
    p = F.col("price").cast("double")
    x = windows.near(t, lambda d, s: d.withColumn("l", p / F.lag(p).over(ordered(s))), 1)
    x = x.select(F.when(F.col("size") < 3, 0).otherwise(F.col("side")).alias("s"), "l").dropna()
    out = evaluation.weighted_f1(x, F.col("s"), F.col("l"), F.lit(1.0))
    return out.select(*[F.round(c, 4).alias(c) for c in ("tp", "fp", "fn")], F.round("f1", 6).alias("f1"))


@table_query("l21_quantiles_wide", """SELECT event_id, round(value / 500 * 0.9, 6) + 0.0 AS q10, round(value / 500, 6) + 0.0 AS q50, round(value / 500 * 1.1, 6) + 0.0 AS q90 FROM events""")
def l21(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = F.col("value") / 500
    wide = e.select("event_id", (p * 0.9).alias("q10"), p.alias("q50"), (p * 1.1).alias("q90"))
    long = wide.unpivot("event_id", ["q10", "q50", "q90"], "quantile", "p")
    return rounded(long.groupBy("event_id").pivot("quantile", ["q10", "q50", "q90"]).agg(F.first("p")))


@query("l24_extreme_events", "ticks", """WITH q AS (SELECT exchange, symbol, quantile_cont(CAST(price AS DOUBLE), 0.01) AS a, quantile_cont(CAST(price AS DOUBLE), 0.99) AS z FROM ticks GROUP BY exchange, symbol)
SELECT exchange, symbol, ts, seq, round(CAST(price AS DOUBLE), 6) AS price FROM ticks JOIN q USING (exchange, symbol) WHERE CAST(price AS DOUBLE) < a OR CAST(price AS DOUBLE) > z""")
def l24(t):
    """Rows outside the 1st and 99th percentile of their symbol."""
    x = t.select("exchange", "symbol", "ts", "seq", F.col("price").cast("double").alias("price"))
    q = selection.percentiles(x, ["exchange", "symbol"], "price", [0.01, 0.99])
    return rounded(x.join(q, ["exchange", "symbol"]).where((F.col("price") < F.col("q")[0]) | (F.col("price") > F.col("q")[1])).drop("q"))


# ---- column filters and pair statistics -------------------------------------------------------------------


@table_query("g22_low_variance", """WITH l AS (SELECT unnest(range(0, len(embedding))) AS feature, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT feature, var_samp(v) AS variance FROM l GROUP BY feature)
SELECT CAST(feature AS INT) AS feature, round(variance, 6) AS variance, variance >= (SELECT quantile_cont(variance, 0.5) / 2 FROM s) AS kept FROM s""")
def g22(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    long = e.select(F.posexplode("embedding").alias("feature", "v")).withColumn("v", F.col("v").cast("double"))
    return rounded(evaluation.low_variance(long, "feature", "v"))


@query("g23_coverage", "holes", f"""WITH a AS (SELECT exchange, symbol, price, row_number() OVER ({W}) - 1 AS ix FROM holes), s AS (SELECT exchange, symbol, max(ix) FILTER (price IS NOT NULL) - min(ix) FILTER (price IS NOT NULL) AS span FROM a GROUP BY exchange, symbol)
SELECT exchange, symbol, span, span >= (SELECT avg(span) FROM s) AS kept FROM s""")
def g23(h):
    return evaluation.coverage(labels.indexed(h), ["exchange", "symbol"], "ix", "price")


@query("g20_correlations", "ticks", """WITH h AS (SELECT exchange, symbol, date_trunc('hour', ts) AS ts, CAST(last(price ORDER BY ts, seq) AS DOUBLE) AS p FROM ticks GROUP BY 1, 2, 3)
SELECT a.exchange, a.symbol AS a, b.symbol AS b, round(corr(a.p, b.p), 6) + 0.0 AS corr FROM h a JOIN h b ON a.ts = b.ts AND a.exchange = b.exchange AND a.symbol < b.symbol GROUP BY 1, 2, 3 HAVING count(*) > 2""")
def g20(t):
    """One pivot and one aggregation for all pairs of a fixed symbol list; no join of rows."""
    names = [f"S{i}" for i in range(5)]
    h = bars.time_bars(t, "1 hour").select("exchange", "symbol", "ts", F.col("close").cast("double").alias("p"))
    wide = h.groupBy("exchange", "ts").pivot("symbol", names).agg(F.first("p"))
    pairs = [(a, b) for a in names for b in names if a < b]
    one = wide.groupBy("exchange").agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr"), F.regr_count(F.col(a), F.col(b)).alias("n")) for a, b in pairs]).alias("x"))
    return rounded(one.select("exchange", F.inline("x")).where("n > 2").drop("n"))


@query("g24_stationary", "ticks", f"""WITH a AS (SELECT exchange, symbol, CAST(price AS DOUBLE) AS p, lag(CAST(price AS DOUBLE)) OVER ({W}) AS q FROM ticks), s AS (SELECT exchange, symbol, regr_slope(p - q, q) AS b, regr_sxx(p - q, q) AS x, regr_syy(p - q, q) AS y, regr_count(p - q, q) AS n FROM a GROUP BY exchange, symbol)
SELECT exchange, symbol, round(b / sqrt((y - b * b * x) / (n - 2) / x), 4) AS t, b / sqrt((y - b * b * x) / (n - 2) / x) <= -2.86 AS stationary FROM s""")
def g24(t):
    p = F.col("price").cast("double")
    x = windows.near(t, lambda r, s: r.withColumn("q", F.lag(p).over(ordered(s))), 1).withColumn("d", p - F.col("q"))
    return evaluation.dickey_fuller(x, ["exchange", "symbol"], "d", "q").withColumn("t", F.round("t", 4))


@query("g26_ensemble_average", "ticks", """SELECT exchange, symbol, date_trunc('hour', ts) AS ts, round(avg(CAST(price AS DOUBLE)), 9) AS mean, round(CAST(sum(price * size) AS DOUBLE) / CAST(sum(size) AS DOUBLE), 9) AS weighted FROM ticks GROUP BY 1, 2, 3""")
def g26(t):
    p, w = F.col("price").cast("double"), F.col("size").cast("double")
    mean, weighted = F.round(F.avg(p), 9).alias("mean"), F.round(F.sum(p * w) / F.sum(w), 9).alias("weighted")
    return t.groupBy("exchange", "symbol", F.date_trunc("hour", "ts").alias("ts")).agg(mean, weighted)


# ---- joins for training frames ----------------------------------------------------------------------------

_H = "h AS (SELECT exchange, symbol, date_trunc('hour', ts) AS ts, CAST(last(price ORDER BY ts, seq) AS DOUBLE) AS close, CAST(sum(size) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2, 3)"
_Q = "q AS (SELECT exchange, symbol, date_trunc('hour', ts) AS ts, CAST(last(bid ORDER BY ts, seq) AS DOUBLE) AS bid FROM quotes GROUP BY 1, 2, 3)"


def _hours(spark, sf_dir):
    t, q = (views.frame(spark, sf_dir, v) for v in (views.TICKS, views.QUOTES))
    h = bars.time_bars(t, "1 hour").select("exchange", "symbol", "ts", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"))
    b = bars.quote_bars(q, "1 hour").select("exchange", "symbol", "ts", F.col("bid_close").cast("double").alias("bid"))
    return h, b


@table_query("j04_features_and_label", f"""WITH {_H}, {_Q}, o AS (SELECT exchange, symbol, ts, close, bid FROM h FULL JOIN q USING (exchange, symbol, ts)),
f AS (SELECT exchange, symbol, ts, last_value(close IGNORE NULLS) OVER w AS close, last_value(bid IGNORE NULLS) OVER w AS bid FROM o WINDOW w AS (PARTITION BY exchange, symbol ORDER BY ts)) SELECT exchange, symbol, ts, round(close, 6) AS close, round(bid, 6) AS bid FROM f WHERE close IS NOT NULL AND bid IS NOT NULL""")
def j04(spark, sf_dir):
    h, b = _hours(spark, sf_dir)
    out = h.drop("volume").join(b, ["exchange", "symbol", "ts"], "full")
    return rounded(out.withColumns({c: windows.ffill(c, order=("ts",)) for c in ("close", "bid")}).dropna())


@table_query("j05_volatility", f"""WITH d AS (SELECT exchange, symbol, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ts, stddev_samp(CAST(price AS DOUBLE)) AS v FROM ticks GROUP BY 1, 2, 3)
SELECT t.exchange, t.symbol, t.ts, t.seq, round(d.v, 6) AS volatility FROM ticks t ASOF LEFT JOIN (SELECT * FROM d WHERE v IS NOT NULL) d ON t.exchange = d.exchange AND t.symbol = d.symbol AND t.ts >= d.ts""")
def j05(spark, sf_dir):
    """The volatility of the last full hour at each tick."""
    t = views.frame(spark, sf_dir, views.TICKS)
    hour = (F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")).alias("ts")
    v = t.groupBy("exchange", "symbol", hour).agg(F.stddev_samp(F.col("price").cast("double")).alias("volatility")).dropna().withColumn("seq", F.lit(0))
    return rounded(joins.asof(t.select("exchange", "symbol", "ts", "seq"), v, ["exchange", "symbol"], ["volatility"]))


@table_query("j06_prediction_and_label", f"WITH {_H}, {_Q} SELECT exchange, symbol, ts, round(close, 6) AS close, round(bid, 6) AS bid FROM h JOIN q USING (exchange, symbol, ts)")
def j06(spark, sf_dir):
    h, b = _hours(spark, sf_dir)
    return rounded(h.drop("volume").join(b, ["exchange", "symbol", "ts"]))


@table_query("j17_deal_volume", f"WITH {_H}, {_Q} SELECT exchange, symbol, ts, round(bid, 6) AS bid, coalesce(volume, 0.0) AS volume FROM q LEFT JOIN h USING (exchange, symbol, ts)")
def j17(spark, sf_dir):
    h, b = _hours(spark, sf_dir)
    return rounded(b.join(h.drop("close"), ["exchange", "symbol", "ts"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0))))


@query("j18_latest_peak_and_valley", "ticks", f"""WITH a AS (SELECT exchange, symbol, ts, seq, CAST(price AS DOUBLE) AS p, lag(CAST(price AS DOUBLE), 1) OVER w AS q, lag(CAST(price AS DOUBLE), 2) OVER w AS r FROM ticks WINDOW w AS ({W})),
b AS (SELECT *, CASE WHEN q > p AND q > r THEN q END AS peak, CASE WHEN q < p AND q < r THEN q END AS valley FROM a)
SELECT exchange, symbol, ts, seq, round(coalesce(last_value(peak IGNORE NULLS) OVER ({W}), 99999), 6) AS peak, round(coalesce(last_value(valley IGNORE NULLS) OVER ({W}), 0), 6) AS valley FROM b""")
def j18(t):
    """A peak is known one row after it."""

    def turns(d, s):
        p, w = F.col("price").cast("double"), ordered(s)
        q, r = F.lag(p, 1).over(w), F.lag(p, 2).over(w)
        return d.withColumns({"peak": F.when((q > p) & (q > r), q), "valley": F.when((q < p) & (q < r), q)})

    x = windows.filled(windows.near(t, turns, 2), {"peak": "peak", "valley": "valley"})
    filled = {"peak": F.coalesce("peak", F.lit(99999.0)), "valley": F.coalesce("valley", F.lit(0.0))}
    return rounded(x.withColumns(filled).select("exchange", "symbol", "ts", "seq", "peak", "valley"))


# ---- gapless volume bars ----------------------------------------------------------------------------------


@query("f10_padded_bars", "ticks", f"""WITH c AS (SELECT *, CAST(floor(sum(CAST(price * size AS DECIMAL(38,10))) OVER ({W}) / 500) AS BIGINT) AS k FROM ticks),
b AS (SELECT exchange, symbol, k, max(ts) AS ts, CAST(first(price ORDER BY ts, seq) AS DOUBLE) AS open, CAST(last(price ORDER BY ts, seq) AS DOUBLE) AS close,
sum(CASE WHEN side > 0 THEN size ELSE 0 END) AS vb, sum(CASE WHEN side > 0 THEN 0 ELSE size END) AS vs, count(*) FILTER (side > 0) AS cb, count(*) FILTER (side <= 0) AS cs FROM c GROUP BY exchange, symbol, k),
s AS (SELECT exchange, symbol, unnest(generate_series(min(k), max(k))) AS k FROM b GROUP BY exchange, symbol),
j AS (SELECT s.exchange, s.symbol, s.k, b.* EXCLUDE (exchange, symbol, k), min(b.k) OVER (PARTITION BY s.exchange, s.symbol ORDER BY s.k DESC) AS island FROM s LEFT JOIN b ON b.exchange = s.exchange AND b.symbol = s.symbol AND b.k = s.k),
i AS (SELECT exchange, symbol, k, coalesce(open, max(open) OVER w) AS open, coalesce(close, max(open) OVER w) AS close, max(ts) OVER w AS ts, max(vb) OVER w AS vb, max(vs) OVER w AS vs, max(cb) OVER w AS cb, max(cs) OVER w AS cs, count(*) OVER w AS n FROM j WINDOW w AS (PARTITION BY exchange, symbol, island)),
r AS (SELECT *, CAST(floor(vb / n) AS BIGINT) AS b2, CAST(floor(vs / n) AS BIGINT) AS s2, CAST(CASE WHEN cb > 0 THEN floor(greatest(cb / n, 1)) ELSE 0 END AS BIGINT) AS c2, CAST(CASE WHEN cs > 0 THEN floor(greatest(cs / n, 1)) ELSE 0 END AS BIGINT) AS d2 FROM i)
SELECT exchange, symbol, k AS volume_tick, ts, round(open, 6) AS open, round(close, 6) AS close, b2 AS volume_buy, s2 AS volume_sell, b2 + s2 AS volume, c2 + d2 AS n, round((b2 + s2) / nullif(c2 + d2, 0), 6) AS volume_mean FROM r""")
def f10(t):
    out = padding.pad(bars.dollar_bars(t, 500))
    return rounded(out.select("exchange", "symbol", "volume_tick", "ts", "open", "close", "volume_buy", "volume_sell", "volume", "n", "volume_mean"))


@query("f15_held_sizes", "ticks", f"""WITH c AS (SELECT *, CAST(floor(sum(CAST(price * size AS DECIMAL(38,10))) OVER ({W}) / 200) AS BIGINT) AS k FROM ticks),
b AS (SELECT exchange, symbol, k, CAST(floor(CAST(last(price ORDER BY ts, seq) AS DOUBLE) / 20) * 20 AS DOUBLE) AS close, CAST(sum(size) AS DOUBLE) AS v FROM c GROUP BY exchange, symbol, k),
s AS (SELECT exchange, symbol, unnest(generate_series(min(k), max(k))) AS k FROM b GROUP BY exchange, symbol), j AS (SELECT exchange, symbol, k, close, v FROM s LEFT JOIN b USING (exchange, symbol, k)),
f AS (SELECT *, last_value(close IGNORE NULLS) OVER u AS p, first_value(close IGNORE NULLS) OVER d AS q, last_value(v IGNORE NULLS) OVER u AS fv FROM j WINDOW u AS (PARTITION BY exchange, symbol ORDER BY k), d AS (PARTITION BY exchange, symbol ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT exchange, symbol, k AS volume_tick, coalesce(v, CASE WHEN p = q THEN fv END) AS equal_gaps, fv AS all_gaps FROM f""")
def f15(t):
    """Sizes held inside gaps: where both ends have the same price (F15), and in all gaps (F18)."""
    b = bars.dollar_bars(t, 200).withColumn("close", F.floor(F.col("close").cast("double") / 20) * 20.0)
    rows = padding.spine(b.select("exchange", "symbol", "volume_tick", "close", F.col("volume").cast("double").alias("equal_gaps"), F.col("volume").cast("double").alias("all_gaps")))
    out = padding.hold_sizes(padding.hold_sizes(rows, "close", ["equal_gaps"], True), "close", ["all_gaps"], False)
    return out.select("exchange", "symbol", "volume_tick", "equal_gaps", "all_gaps")
