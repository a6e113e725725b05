"""Queries over screens, importances, pairs, samples, names and relative curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalars
from tickloom.operators import bars, selection, windows
from tickloom.operators.windows import ordered
from tickloom.plans.features import DAY, DAYS, D, day_series
from tickloom.plans.registry import query, rounded, table_query

W = "PARTITION BY exchange, symbol ORDER BY ts, seq"
P = "CAST(price AS DOUBLE)"
HOURS = f"h AS (SELECT exchange, symbol, date_trunc('hour', ts) AS ts, arg_max({P}, (ts, seq)) AS close FROM ticks GROUP BY 1, 2, 3)"


def hours(t):
    return bars.time_bars(t, "1 hour").select("exchange", "symbol", "ts", F.col("close").cast("double").alias("close"))


@query("g18_summaries", "ticks", f"""WITH {HOURS}, s AS (SELECT *, row_number() OVER w AS i, coalesce(close - lag(close) OVER w, 0.0) AS d FROM h WINDOW w AS (PARTITION BY exchange, symbol ORDER BY ts)),
r AS (SELECT exchange, symbol, count(*) AS n, arg_min(close, i) AS a, arg_max(close, i) AS z, corr(close, i) AS k, avg(d) AS m, stddev_pop(d) AS sd, avg(least(d, 0)) AS lm, stddev_pop(least(d, 0)) AS ls FROM s GROUP BY exchange, symbol)
SELECT exchange, symbol, n, CAST(0 AS BIGINT) AS leading_nulls, round((z - a) / a, 6) + 0.0 AS "return", round(k * k, 6) AS r2, round(m / sd * sqrt(n), 6) + 0.0 AS sharpe, round(lm / ls * sqrt(n), 6) + 0.0 AS sortino FROM r""")
def g18(t):
    return rounded(selection.summaries(hours(t), "close", ["exchange", "symbol"], ["ts"]))


@query("g19_screen", "ticks", f"SELECT exchange, symbol, ts, seq, {P} AS price, CAST(size AS DOUBLE) AS size FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol, CAST(ts AS DATE) ORDER BY price DESC, seq DESC) AS r FROM ticks) WHERE r = 1 AND size >= 3 AND price > 150")
def g19(t):
    """The best tick of each symbol's day, where it is large and dear."""
    x = t.select(F.concat_ws("|", "exchange", "symbol", F.to_date("ts")).alias("key"), "exchange", "symbol", "ts", "seq", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"))
    return selection.best_per_key(x, "key", [F.col("price"), F.col("seq")], (F.col("size") >= 3) & (F.col("price") > 150)).drop("key")


CENTS = [p / 100 for p in range(1, 100)]
USERS = "u AS (SELECT user_id, avg(value) AS a, CAST(count(*) AS DOUBLE) AS b FROM events GROUP BY user_id)"


@table_query("g21_joint_percentile", f"""WITH {USERS}, p AS (SELECT unnest(range(1, 100)) AS p), q AS (SELECT quantile_cont(a, {CENTS}) AS qa, quantile_cont(b, {CENTS}) AS qb FROM u),
n AS (SELECT p, count(*) AS n FROM u, q, p WHERE a > qa[p] AND b > qb[p] GROUP BY p) SELECT CAST(coalesce(max(p) FILTER (n > 5), 1) AS INT) AS level FROM n""")
def g21(spark, sf_dir):
    u = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.avg("value").alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    return selection.joint_percentile(u, ["a", "b"], 5)


@query("g25_pairs", "ticks", f"""WITH {HOURS}, j AS (SELECT x.exchange, x.symbol AS s, y.symbol AS z, x.ts, x.close AS a, y.close AS b FROM h x JOIN h y ON x.exchange = y.exchange AND x.ts = y.ts AND x.symbol < y.symbol),
l AS (SELECT exchange, s, z, corr(a, b) AS corr, regr_slope(a, b) AS beta, regr_intercept(a, b) AS alpha FROM j GROUP BY exchange, s, z HAVING count(*) > 9), r AS (SELECT exchange, s, z, ts, a - alpha - beta * b AS r FROM j JOIN l USING (exchange, s, z)),
d AS (SELECT exchange, s, z, r - lag(r) OVER w AS c, lag(r) OVER w AS b FROM r WINDOW w AS (PARTITION BY exchange, s, z ORDER BY ts)), k AS (SELECT exchange, s, z, regr_slope(c, b) AS slope, regr_sxx(c, b) AS sxx, regr_syy(c, b) AS syy, regr_count(c, b) AS n FROM d GROUP BY exchange, s, z)
SELECT exchange, s AS a, z AS b, round(corr, 6) + 0.0 AS corr, round(alpha, 4) + 0.0 AS alpha, round(beta, 6) + 0.0 AS beta, round(slope / sqrt((syy - slope * slope * sxx) / (n - 2) / sxx), 5) + 0.0 AS t, slope / sqrt((syy - slope * slope * sxx) / (n - 2) / sxx) <= -3.34 AS stationary FROM l JOIN k USING (exchange, s, z)""")
def g25(t):
    """Every two symbols of an exchange that share ten hours or more."""
    pairs = selection.pairs_of(hours(t), ["exchange", "ts"], "symbol", "close")
    enough = pairs.groupBy("exchange", "a", "b").count().where("count > 9").drop("count")
    out = selection.cointegration(pairs.join(enough, ["exchange", "a", "b"]), "x", "y", ["exchange", "a", "b"], ["ts"])
    return rounded(out.withColumns({"t": F.round("t", 5), "alpha": F.round("alpha", 4)}))


SCORES = "f AS (SELECT event_type AS model, 'f' || CAST(user_id % 20 AS VARCHAR) AS feature, sum(value) / sum(sum(value)) OVER (PARTITION BY event_type) AS score FROM events GROUP BY event_type, user_id % 20)"


def scores(spark, sf_dir):
    """Importances by model: shares of value by event type and user group."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("model"), F.concat(F.lit("f"), F.col("user_id") % 20).alias("feature")).agg(F.sum("value").alias("s"))
    total = e.groupBy("model").agg(F.sum("s").alias("t"))
    return e.join(F.broadcast(total), "model").select("model", "feature", (F.col("s") / F.col("t")).alias("score"))


@table_query("j15_important_features", f"""WITH {SCORES}, c AS (SELECT feature, sum(score) OVER (PARTITION BY model ORDER BY score DESC, feature ROWS UNBOUNDED PRECEDING) < 0.3 AS s FROM f)
SELECT feature, CASE WHEN feature = 'close' THEN true ELSE bool_or(s) END AS selected FROM (SELECT * FROM c UNION ALL SELECT 'close', true) GROUP BY feature""")
def j15(spark, sf_dir):
    return selection.important(scores(spark, sf_dir), "model", "feature", "score", 0.3, ["close"])


@table_query("l23_mean_importance", f"""WITH {SCORES}, m AS (SELECT feature, sum(score) / (SELECT count(DISTINCT model) FROM f) AS m FROM f GROUP BY feature), s AS (SELECT feature, m / sum(m) OVER () AS share FROM m),
r AS (SELECT *, sum(share) OVER (ORDER BY share DESC, feature ROWS UNBOUNDED PRECEDING) AS running FROM s) SELECT feature, round(share, 6) AS share, round(running, 6) AS running, running < 0.8 AS kept FROM r""")
def l23(spark, sf_dir):
    return rounded(selection.mean_importance(scores(spark, sf_dir), "model", "feature", "score", 0.8))


@query("l13_chunk_order", "ticks", f"""WITH a AS (SELECT exchange, symbol, ts, seq, row_number() OVER ({W}) - 1 AS ix, count(*) OVER (PARTITION BY exchange, symbol) AS n FROM ticks),
c AS (SELECT *, CASE WHEN ix < (n % 25) * (n // 25 + 1) THEN ix // (n // 25 + 1) ELSE n % 25 + (ix - (n % 25) * (n // 25 + 1)) // (n // 25) END AS chunk FROM a), p AS (SELECT *, chunk // 5 + 5 * (chunk % 5) AS place FROM c)
SELECT exchange, symbol, seq, ix, chunk, place, row_number() OVER (PARTITION BY exchange, symbol ORDER BY place, ix) - 1 AS new_ix FROM p""")
def l13(t):
    return selection.chunk_order(t, 5).select("exchange", "symbol", "seq", "ix", "chunk", "place", "new_ix")


@query("l22_confident_signals", "ticks", f"""WITH a AS (SELECT exchange, symbol, seq, size, {P} / 500 AS p, lead({P}) OVER ({W}) / {P} - 1 AS r FROM ticks), q AS (SELECT exchange, symbol, quantile_cont(p, 0.9) AS q FROM a GROUP BY exchange, symbol)
SELECT exchange, symbol, count(*) FILTER (p >= 0.5) AS signals, round(avg(r) FILTER (p >= 0.5), 6) + 0.0 AS "return", round(q, 6) AS top, round(avg(r) FILTER (p >= q), 6) + 0.0 AS top_return FROM a JOIN q USING (exchange, symbol) GROUP BY exchange, symbol, q""")
def l22(t):
    """Returns after signals over a probability, and after the most confident tenth of each symbol."""
    price = F.col("price").cast("double")
    a = windows.near(t, lambda d, s: d.withColumn("r", F.lead(price).over(ordered(s)) / price - 1), 0, 1).select("exchange", "symbol", (price / 500).alias("p"), "r")
    q = selection.percentiles(a, ["exchange", "symbol"], "p", [0.9]).select("exchange", "symbol", F.col("q")[0].alias("top"))
    g = a.join(q, ["exchange", "symbol"]).groupBy("exchange", "symbol", "top").agg(F.count_if(F.col("p") >= 0.5).alias("signals"), F.avg(F.when(F.col("p") >= 0.5, F.col("r"))).alias("return"), F.avg(F.when(F.col("p") >= F.col("top"), F.col("r"))).alias("top_return"))
    return rounded(g)


@query("p11_cut_where_many", "ticks", f"""WITH b AS (SELECT min({P}) AS a, max({P}) AS z FROM ticks) SELECT exchange, symbol, ts, seq, CAST(greatest(least(ceil(({P} - a) * 10 / (z - a)) - 1, 9), 0) AS DOUBLE) AS price, CAST(size AS DOUBLE) AS size FROM ticks, b""")
def p11(t):
    x = t.select("exchange", "symbol", "ts", "seq", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"))
    return selection.cut_where_many(x, ["price", "size"], 20, 10)


@query("p16_precision_and_scale", "ticks", f"""WITH a AS (SELECT exchange, symbol, ts, seq, {P} AS x FROM ticks), m AS (SELECT *, length(CAST(CAST(floor(x) AS BIGINT) AS VARCHAR)) AS m FROM a),
s AS (SELECT *, length(rtrim(CAST(CAST(power(10.0, 14 - m) + floor(power(10.0, 14 - m) * (x - floor(x)) + 0.5) AS BIGINT) AS VARCHAR), '0')) - 1 AS s FROM m) SELECT exchange, symbol, ts, seq, CAST(m + s AS INT) AS "precision", CAST(s AS INT) AS scale FROM s""")
def p16(t):
    x = t.withColumn("x", F.col("price").cast("double"))
    p, s = scalars.precision_and_scale("x")
    return x.select("exchange", "symbol", "ts", "seq", p.cast("int").alias("precision"), s.cast("int").alias("scale"))


@query("p20_lineage", "ticks", "SELECT DISTINCT symbol AS asset, CAST(side AS VARCHAR) AS side, 'deal bars' AS measurement, CAST(5 + seq % 3 AS INT) AS aggwindow, 'mean' AS aggregator, CAST(3 AS INT) AS n_tags FROM ticks")
def p20(t):
    """Names of curves and back: tags, window, aggregator."""
    name = F.concat(F.lit("asset-"), "symbol", F.lit("|side-"), F.col("side").cast("string"), F.lit("|measurement-deal_bars|levels-5|aggWindow-"), (5 + F.col("seq") % 3).cast("string"), F.lit("|aggAggregator-mean"))
    tags, window, agg = scalars.lineage("name")
    x = t.select(name.alias("name")).distinct().select(tags.alias("tags"), window.alias("aggwindow"), agg.alias("aggregator"))
    return x.select(*[F.col("tags")[k].alias(k) for k in ("asset", "side", "measurement")], "aggwindow", "aggregator", F.size("tags").alias("n_tags"))


@query("p29_same_columns", "ticks", f"""WITH v AS (SELECT var_pop({P}) AS p, var_pop(CAST(size AS DOUBLE)) AS z FROM ticks)
SELECT 'copy' AS feature, round(p, 4) AS variance, 'copy' AS same_as, true AS kept FROM v UNION ALL SELECT 'price', round(p, 4), 'copy', false FROM v UNION ALL SELECT 'size', round(z, 4), 'size', true FROM v UNION ALL SELECT 'one', 0.0, 'one', false FROM v""")
def p29(t):
    x = t.select("seq", F.col("price").cast("double").alias("price"), F.col("price").cast("double").alias("copy"), F.col("size").cast("double").alias("size"), F.lit(1.0).alias("one"))
    out = selection.same_columns(x.unpivot(["seq"], ["price", "copy", "size", "one"], "feature", "value"), "feature", "seq", "value", 0.01)
    return out.withColumn("variance", F.round("variance", 4) + 0.0)


@query("p31_timestamps", "ticks", "SELECT exchange, symbol, seq, date_trunc('millisecond', ts) AS ts, date_trunc('second', ts) AS text_ts FROM ticks")
def p31(t):
    """A day and its seconds, and text, as timestamps."""
    day = F.to_date("ts")
    seconds = F.unix_millis("ts") / 1000 - F.unix_seconds(day.cast("timestamp"))
    text = F.date_format("ts", "yyyy-MM-dd'D'HH:mm:ss")
    return t.select("exchange", "symbol", "seq", scalars.at_seconds(day, seconds).alias("ts"), F.to_timestamp(text, "yyyy-MM-dd'D'HH:mm:ss").alias("text_ts"))


@query("p32_feature_list", "ticks", f"SELECT CAST(size AS DOUBLE) AS size, CAST(NULL AS DOUBLE) AS absent, {P} AS price FROM ticks")
def p32(t):
    x = t.withColumns({"price": F.col("price").cast("double"), "size": F.col("size").cast("double")})
    return scalars.to_features(x, ["size", "absent", "price"])


@query("o06_sample", "ticks", f"SELECT exchange, symbol, ts, seq FROM ticks WHERE substr(md5('7' || CAST(seq AS VARCHAR)), 1, 8) < '{int(0.1 * 16**8):08x}'")
def o06(t):
    return selection.sampled(t, F.col("seq"), 0.1, "7").select("exchange", "symbol", "ts", "seq")


@query("t20_relative_curves", "daily", f"WITH {DAYS} SELECT {DAY}, round(c / nullif(avg(c) OVER (ORDER BY day ROWS 29 PRECEDING), 0) - 1, 6) + 0.0 AS rel, round(c - lag(c) OVER ({D}), 6) + 0.0 AS d1, round(c / nullif(lag(c, 30) OVER ({D}), 0) - 1, 6) + 0.0 AS d30 FROM a")
def t20(d):
    w = ordered()
    x = day_series(d)
    c = F.col("close")
    return rounded(x.select(F.col("day").cast("string").alias("day"), scalars.relative(c, F.avg("close").over(w.rowsBetween(-29, 0))).alias("rel"), (c - F.lag("close").over(w)).alias("d1"), scalars.relative(c, F.lag("close", 30).over(w)).alias("d30")))
