"""Queries over scalar functions, more indicators, points of the tag store and merged series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import views
from tickloom.functions import indicators as ta
from tickloom.functions import scalars
from tickloom.operators import bars, store, windows
from tickloom.operators.windows import ordered
from tickloom.plans.features import DAY, DAYS, D, HOURLY, LEDGER, day_series, hourly, ledger, win
from tickloom.plans.registry import query, rounded, table_query

W = "PARTITION BY exchange, symbol ORDER BY ts, seq"
P = "CAST(price AS DOUBLE)"


def priced(t):
    return t.withColumns({"price": F.col("price").cast("double"), "size": F.col("size").cast("double")})


@query("p12_interactions", "ticks", f"SELECT exchange, symbol, ts, seq, 1.0::DOUBLE AS one, {P} AS price, CAST(size AS DOUBLE) AS size, round({P} * {P}, 6) AS price_price, round({P} * size, 6) AS price_size, CAST(size * size AS DOUBLE) AS size_size FROM ticks")
def p12(t):
    return rounded(priced(t).select("exchange", "symbol", "ts", "seq", *[v.alias(k) for k, v in scalars.interactions(["price", "size"]).items()]))


@query("p17_aliases_and_units", "ticks", f"SELECT CASE symbol WHEN 'S0' THEN 'ZERO' WHEN 'S1' THEN 'ONE' ELSE symbol END AS symbol, exchange, ts, seq, round(CASE WHEN symbol LIKE 'S4%' THEN {P} * 1e6 ELSE {P} END, 4) AS price FROM ticks")
def p17(t):
    """Symbol aliases (P18) and inflated low-value assets (P17)."""
    x = priced(t).withColumn("price", scalars.inflated("price", "symbol", "S4"))
    return x.select(scalars.aliased("symbol", {"S0": "ZERO", "S1": "ONE"}).alias("symbol"), "exchange", "ts", "seq", F.round("price", 4).alias("price"))


@query("p21_fees", "ticks", f"SELECT exchange, symbol, ts, seq, round({P} * size * CASE WHEN side > 0 THEN 0.00075 ELSE -0.00025 END, 8) + 0.0 AS fee FROM ticks")
def p21(t):
    kind = F.when(F.col("side") > 0, "market").otherwise("limit")
    f = scalars.fee("price", "size", {"market": 0.00075, "limit": -0.00025}, kind)  # seven decimals: no ties at eight
    return priced(t).select("exchange", "symbol", "ts", "seq", (F.round(f, 8) + 0.0).alias("fee"))


@query("p23_time_range", "ticks", f"SELECT exchange, symbol, ts + INTERVAL 1 HOUR AS ts, seq, {P} AS price FROM ticks WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def p23(t):
    """A half-open range of time (P23), shifted by the resolution (P24)."""
    x = priced(t).where("ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
    return x.select("exchange", "symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), "seq", "price")


@query("p25_missing_days", "daily", "WITH b AS (SELECT min(CAST(day AS DATE)) AS a, max(CAST(day AS DATE)) AS z FROM daily), s AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM b) SELECT CAST(day AS VARCHAR) AS day FROM s WHERE day NOT IN (SELECT CAST(day AS DATE) FROM daily)")
def p25(d):
    days = d.select(F.to_date("day").alias("day"))
    spine = days.agg(F.min("day").alias("a"), F.max("day").alias("z")).select(F.explode(F.expr("sequence(a, z, INTERVAL 1 DAY)")).alias("day"))
    return spine.join(days, "day", "left_anti").select(F.col("day").cast("string").alias("day"))


@query("p26_inverted", "ticks", f"WITH m AS (SELECT exchange, symbol, max(price) AS m FROM ticks GROUP BY exchange, symbol) SELECT exchange, symbol, ts, seq, CAST(2 * m - price AS DOUBLE) AS inverted, round(CASE WHEN price / 150 < 1 THEN 150 / {P} ELSE {P} / 150 END, 6) AS rate FROM ticks JOIN m USING (exchange, symbol)")
def p26(t):
    """Inverted series (P26) and rates below 1 inverted (P28)."""
    x = priced(t)
    m = x.groupBy("exchange", "symbol").agg(F.max("price").alias("m"))
    x = x.join(m, ["exchange", "symbol"]).withColumn("rate", F.col("price") / 150)
    return rounded(x.select("exchange", "symbol", "ts", "seq", (2 * F.col("m") - F.col("price")).alias("inverted"), scalars.above_one("rate").alias("rate")))


@query("p30_synthetic_quotes", "ticks", f"SELECT exchange, symbol, ts, seq, round({P} - 0.25, 6) AS bid, round({P} + 0.25, 6) AS ask FROM ticks")
def p30(t):
    return rounded(priced(t).select("exchange", "symbol", "ts", "seq", *[v.alias(k) for k, v in scalars.synthetic_quotes("price", 0.5).items()]))


@query("t16_money_flow", "daily", f"""WITH {DAYS}, b AS (SELECT *, (h + l + c) / 3 AS t, (h + l + c) / 3 - lag((h + l + c) / 3) OVER ({D}) AS d FROM a),
f AS (SELECT *, CASE WHEN d <> 0 THEN t * v WHEN d = 0 THEN 0 END AS f, CASE WHEN d > 0 THEN t * v WHEN d IS NOT NULL THEN 0 END AS u FROM b)
SELECT {DAY}, CASE WHEN count(f) {win(14)} = 14 THEN round(coalesce(100 * sum(u) {win(14)} / nullif(sum(f) {win(14)}, 0), 0), 6) + 0.0 END AS mfi FROM f""")
def t16(d):
    x = ta.with_mfi(day_series(d), "high", "low", "close", "volume", 14)
    return rounded(x.select(F.col("day").cast("string").alias("day"), "mfi"))


@query("t17_linear_regression", "daily", f"""WITH {DAYS}, b AS (SELECT *, CAST(row_number() OVER ({D}) AS DOUBLE) AS x FROM a),
r AS (SELECT *, CASE WHEN count(*) {win(14)} = 14 THEN regr_slope(c, x) {win(14)} END AS s, regr_intercept(c, x) {win(14)} AS i, CASE WHEN count(*) {win(30)} = 30 THEN corr(h, l) {win(30)} END AS k FROM b)
SELECT {DAY}, round(s, 4) + 0.0 AS slope, round(i + s * x, 3) + 0.0 AS linearreg, round(i + s * (x + 1), 3) + 0.0 AS tsf, round(k, 6) + 0.0 AS correl FROM r""")
def t17(d):
    x = day_series(d).withColumn("x", F.row_number().over(ordered()).cast("double"))
    slope, fit = ta.regression("close", "x", 14)
    x = x.withColumns({"slope": slope, "linearreg": fit, "correl": windows.full(F.col("high"), F.corr("high", "low"), 30, windows.trailing(30))})
    return x.select(F.col("day").cast("string").alias("day"), (F.round("slope", 4) + 0.0).alias("slope"), (F.round("linearreg", 3) + 0.0).alias("linearreg"),
                    (F.round(F.col("linearreg") + F.col("slope"), 3) + 0.0).alias("tsf"), (F.round("correl", 6) + 0.0).alias("correl"))


# ---- points, ledgers, parameters --------------------------------------------------------------------------


@query("s25_points", "ticks", f"""WITH h AS (SELECT exchange, symbol, date_trunc('hour', ts) AS ts, max({P}) AS high, min({P}) AS low FROM ticks GROUP BY 1, 2, 3)
SELECT ts, symbol AS asset, exchange, 'bars' AS measurement, 'high' AS field, high AS value FROM h UNION ALL SELECT ts, symbol, exchange, 'bars', 'low', low FROM h""")
def s25(t):
    h = bars.time_bars(t, "1 hour").select("exchange", "symbol", "ts", F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"))
    points = store.points(h, ["exchange", "symbol", "ts"], ["high", "low"], {"measurement": F.lit("bars"), "asset": F.col("symbol"), "exchange": F.col("exchange")})
    return points.select("ts", F.col("tags")["asset"].alias("asset"), F.col("tags")["exchange"].alias("exchange"), F.col("tags")["measurement"].alias("measurement"), F.col("tags")["field"].alias("field"), "value")


@query("s27_tag_values", "ticks", f"WITH {HOURLY} SELECT DISTINCT 'asset' AS key, symbol AS value FROM h UNION SELECT 'side', side FROM h UNION SELECT 'exchange', exchange FROM h UNION SELECT 'measurement', 'bars' FROM h")
def s27(t):
    return hourly(t).select(F.explode("tags")).distinct()


@query("s29_repeated_keys", "ticks", "SELECT exchange, symbol, date_trunc('hour', ts) AS ts, count(*) AS n FROM ticks GROUP BY 1, 2, 3 HAVING count(*) > 1")
def s29(t):
    return store.repeated(t.withColumn("ts", F.date_trunc("hour", "ts")), ["exchange", "symbol", "ts"])


@table_query("s32_ledger_points", f"WITH {LEDGER} SELECT o_custkey, n, 'placed' AS event, CAST(price AS DOUBLE) AS price FROM g UNION ALL SELECT o_custkey, n, 'filled', round(CAST(price AS DOUBLE) * 0.999, 6) FROM g")
def s32(spark, sf_dir):
    g = ledger(spark, sf_dir).withColumn("price", F.col("price").cast("double"))
    two = F.array(F.struct(F.lit("placed").alias("event"), F.col("price").alias("price")), F.struct(F.lit("filled").alias("event"), (F.col("price") * 0.999).alias("price")))
    return rounded(g.select("o_custkey", "n", F.inline(two)))


@query("s35_watermark", "ticks", """WITH l AS (SELECT exchange, symbol, max(ts) AS loaded FROM ticks WHERE ts < TIMESTAMP '2024-01-20' AND symbol <> 'S3' GROUP BY exchange, symbol), a AS (SELECT exchange, symbol, max(ts) AS available FROM ticks GROUP BY exchange, symbol)
SELECT exchange, symbol, available, loaded FROM a LEFT JOIN l USING (exchange, symbol) WHERE loaded IS NULL OR epoch(available)::BIGINT - epoch(loaded)::BIGINT >= 43200""")
def s35(t):
    loaded = t.where("ts < TIMESTAMP '2024-01-20' AND symbol <> 'S3'")
    return store.watermark(loaded, t, ["exchange", "symbol"], 12).select("exchange", "symbol", "available", "loaded")


@query("s39_parameter_grid", "ticks", f"""WITH p AS (SELECT unnest([5, 20]) AS unit), c AS (SELECT exchange, symbol, ts, unit, floor(sum(side * size) OVER (PARTITION BY exchange, symbol, unit ORDER BY ts, seq) / unit) AS k, seq FROM ticks, p),
d AS (SELECT *, k - coalesce(lag(k) OVER (PARTITION BY exchange, symbol, unit ORDER BY ts, seq), 0) AS v FROM c)
SELECT exchange, symbol, unit, ts, CAST(sum(v) AS BIGINT) AS volume_size FROM d WHERE v <> 0 GROUP BY exchange, symbol, unit, ts HAVING sum(v) <> 0""")
def s39(t):
    """All units in one pass: rows are listed per unit, chunks and windows are keyed by it."""
    rows = t.withColumn("unit", F.explode(F.array(F.lit(5), F.lit(20))))
    keys, flow = ("exchange", "symbol", "unit"), (F.col("side") * F.col("size")).cast(bars.EXACT)
    c = windows.cumsum_chunked(rows, flow, "s", series=keys)
    level = lambda x: F.when(F.col("unit") == 5, bars.whole(x, 5)).otherwise(bars.whole(x, 20))
    v = c.withColumn("v", level(F.col("s")) - level(F.col("s") - flow)).where("v <> 0")
    return v.groupBy(*keys, "ts").agg(F.sum("v").cast("long").alias("volume_size")).where("volume_size <> 0")


@table_query("j09_quotes_and_trades", f"""WITH c AS (SELECT exchange, symbol, ts, price, size, CAST(floor(sum(CAST(price * size AS DECIMAL(38,10))) OVER ({W}) / 5000) AS BIGINT) AS k FROM ticks),
e AS (SELECT exchange, symbol, k AS volume_tick, max(ts) AS ts, count(*) AS n FROM c GROUP BY exchange, symbol, k),
b AS (SELECT q.exchange, q.symbol, e.volume_tick, count(*) AS quotes FROM quotes q ASOF JOIN e ON q.exchange = e.exchange AND q.symbol = e.symbol AND q.ts <= e.ts GROUP BY 1, 2, 3)
SELECT exchange, symbol, volume_tick, n, coalesce(quotes, 0) AS quotes FROM e LEFT JOIN b USING (exchange, symbol, volume_tick)""")
def j09(spark, sf_dir):
    """Deal bars with what the quotes of the same volume tick give; the key is unique on both sides."""
    from tickloom.operators import joins

    t, q = (views.frame(spark, sf_dir, v) for v in (views.TICKS, views.QUOTES))
    e = bars.dollar_bars(t, 5000).select("exchange", "symbol", "ts", "volume_tick", "n")
    b = joins.interval_bin(q.select("exchange", "symbol", "ts", "seq"), e, ["exchange", "symbol"], "volume_tick").groupBy("exchange", "symbol", "volume_tick").agg(F.count(F.lit(1)).alias("quotes"))
    return e.join(b, ["exchange", "symbol", "volume_tick"], "left").select("exchange", "symbol", "volume_tick", "n", F.coalesce("quotes", F.lit(0)).alias("quotes"))


@table_query("j13_merged_series", f"""WITH u AS (SELECT exchange, symbol, date_trunc('minute', ts) AS ts, arg_max({P}, (ts, seq)) AS price FROM ticks GROUP BY 1, 2, 3), v AS (SELECT exchange, symbol, date_trunc('minute', ts) AS ts, arg_max(CAST(bid AS DOUBLE), (ts, seq)) AS bid FROM quotes GROUP BY 1, 2, 3),
o AS (SELECT exchange, symbol, ts, price, bid FROM u FULL JOIN v USING (exchange, symbol, ts))
SELECT exchange, symbol, ts, round(coalesce(first_value(price IGNORE NULLS) OVER d, last_value(price IGNORE NULLS) OVER a), 6) AS price, round(coalesce(first_value(bid IGNORE NULLS) OVER d, last_value(bid IGNORE NULLS) OVER a), 6) AS bid FROM o
WINDOW d AS (PARTITION BY exchange, symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), a AS (PARTITION BY exchange, symbol ORDER BY ts)""")
def j13(spark, sf_dir):
    """One union; the last known value of each column per minute; filled backward, then forward."""
    t, q = (views.frame(spark, sf_dir, v) for v in (views.TICKS, views.QUOTES))
    both = t.select("exchange", "symbol", "ts", "seq", F.col("price").cast("double").alias("price")).unionByName(q.select("exchange", "symbol", "ts", "seq", F.col("bid").cast("double").alias("bid")), allowMissingColumns=True)
    at = F.struct("ts", "seq")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    per = both.groupBy("exchange", "symbol", F.date_trunc("minute", "ts").alias("m")).agg(last("price"), last("bid")).withColumnRenamed("m", "ts")
    order = ("ts",)
    return rounded(per.withColumns({c: F.coalesce(windows.bfill(c, order=order), windows.ffill(c, order=order)) for c in ("price", "bid")}))


@query("f04_filled_bars", "ticks", f"""WITH h AS (SELECT exchange, symbol, date_trunc('hour', ts) AS ts, arg_min({P}, (ts, seq)) AS open, max({P}) AS high, min({P}) AS low, arg_max({P}, (ts, seq)) AS close, CAST(sum(size) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2, 3),
s AS (SELECT exchange, symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY exchange, symbol), f AS (SELECT exchange, symbol, ts, open, high, low, last_value(close IGNORE NULLS) OVER (PARTITION BY exchange, symbol ORDER BY ts) AS close, volume FROM s LEFT JOIN h USING (exchange, symbol, ts))
SELECT exchange, symbol, ts, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, coalesce(volume, 0) AS volume FROM f""")
def f04(t):
    h = bars.time_bars(t, "1 hour").select("exchange", "symbol", "ts", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])
    return rounded(windows.filled_bars(h, "1 hour"))


@query("p05_mid_bars", "quotes", """WITH h AS (SELECT exchange, symbol, date_trunc('hour', ts) AS ts, (arg_max(CAST(bid AS DOUBLE), (ts, seq)) + arg_max(CAST(ask AS DOUBLE), (ts, seq))) / 2 AS close, (max(CAST(bid AS DOUBLE)) + max(CAST(ask AS DOUBLE))) / 2 AS high FROM quotes GROUP BY 1, 2, 3)
SELECT exchange, symbol, ts, round(close, 6) AS close, round(high, 6) AS high, round(close / first_value(close) OVER (PARTITION BY exchange, symbol ORDER BY ts), 6) AS "return" FROM h""")
def p05(q):
    """Mid prices of quote bars (P05), relative to a series' first (P06)."""
    x = bars.quote_bars(q.withColumns({c: F.col(c).cast("double") for c in ("bid", "ask")}), "1 hour")
    x = x.select("exchange", "symbol", "ts", *[((F.col(f"bid_{c}") + F.col(f"ask_{c}")) / 2).alias(c) for c in ("close", "high")])
    return rounded(x.withColumn("return", F.col("close") / F.first("close").over(windows.running(order=("ts",)))))


@query("w12_touches_ahead", "ticks", f"SELECT exchange, symbol, ts, seq, CAST(coalesce(max({P}) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) >= {P} + 50, false) AS INT) AS touched FROM ticks")
def w12(t):
    return windows.with_touches_ahead(priced(t), "price", 20, 50.0, "touched").select("exchange", "symbol", "ts", "seq", "touched")


@query("w21_extended_entries", "ticks", f"SELECT exchange, symbol, ts, seq FROM (SELECT *, max(CAST(price >= 280 AS INT)) OVER ({W} ROWS 4 PRECEDING) AS k FROM ticks) WHERE k = 1")
def w21(t):
    return windows.near(t, lambda d, s: d.withColumn("k", windows.extended(F.col("price") >= 280, 5, s)), 4).where("k").select("exchange", "symbol", "ts", "seq")
