"""Queries over stored points, exports, memberships and normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import views
from tickloom.operators import bars, store
from tickloom.plans.features import HOURLY, hourly
from tickloom.plans.registry import query, rounded, table_query
from tickloom.sources import files

P = "CAST(price AS DOUBLE)"


@query("s11_bar_times", "ticks", f"SELECT exchange, symbol, seq, date_trunc('millisecond', ts) AS ts, {P} AS close FROM ticks")
def s11(t):
    """Named columns and the time of a day's milliseconds."""
    raw = files.by_day(t).select("exchange", "symbol", "seq", "date", "ms", F.col("price").cast("double")).toDF("exchange", "symbol", "seq", "date", "ms", "close")
    return raw.select("exchange", "symbol", "seq", files.bar_time(F.col("date"), F.col("ms")).alias("ts"), "close")


@table_query("s14_bars_by_kind", f"""WITH a AS (SELECT exchange, symbol, date_trunc('hour', ts) AS ts, min(CAST(ask AS DOUBLE)) AS l, max(CAST(ask AS DOUBLE)) AS h FROM quotes GROUP BY 1, 2, 3), b AS (SELECT exchange, symbol, date_trunc('hour', ts) AS ts, min({P}) AS l, max({P}) AS h FROM ticks GROUP BY 1, 2, 3)
SELECT exchange, symbol, ts, 'ask' AS kind, round(h, 6) AS high, round(l, 6) AS low FROM a UNION ALL SELECT exchange, symbol, ts, 'deal', h, l FROM b""")
def s14(spark, sf_dir):
    """Bars of trades or of a side of the quotes (S15), by the same names."""
    t, q = (views.frame(spark, sf_dir, v) for v in (views.TICKS, views.QUOTES))
    quotes = bars.quote_bars(q, "1 hour")
    ask = quotes.select("exchange", "symbol", *files.series_columns("ask", quotes.columns))
    ask = ask.select("exchange", "symbol", "ts", F.lit("ask").alias("kind"), F.col("ask_high").cast("double").alias("high"), F.col("ask_low").cast("double").alias("low"))
    deal = bars.time_bars(t, "1 hour").select("exchange", "symbol", "ts", F.lit("deal").alias("kind"), F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"))
    return rounded(ask.unionByName(deal))


@query("s26_delete_and_retag", "ticks", f"""WITH {HOURLY}, k AS (SELECT * FROM h WHERE NOT (side = '-1' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15'))
SELECT ts, exchange, symbol AS asset, max(value) AS value, CAST(3 AS INT) AS n_tags FROM k GROUP BY ts, exchange, symbol""")
def s26(t):
    kept = store.without(hourly(t), F.col("tags")["side"] == "-1", "2024-01-05", "2024-01-15")
    return store.retagged(kept, "bars", ["side"]).select("ts", F.col("tags")["asset"].alias("asset"), F.col("tags")["exchange"].alias("exchange"), "value", F.size("tags").alias("n_tags"))


@query("s28_typed_points", "ticks", f"""SELECT ts, symbol AS owner, 'prediction' AS measurement, 'long' AS field, {P} / 500 AS value FROM ticks UNION ALL SELECT ts, symbol, 'prediction', 'short', 1 - {P} / 500 FROM ticks UNION ALL SELECT ts, symbol, 'label', 'label', CAST(side AS DOUBLE) FROM ticks WHERE side > 0""")
def s28(t):
    """Predictions, one series per model (S31), and labels above 0 (S30)."""
    x = t.select("ts", "symbol", (F.col("price").cast("double") / 500).alias("long"), (1 - F.col("price").cast("double") / 500).alias("short"), F.col("side").cast("double").alias("label"))
    both = store.prediction_points(x, "symbol", ["long", "short"]).unionByName(store.label_points(x, "label", "symbol"))
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    return both.select("ts", F.coalesce(tag("model"), tag("asset")).alias("owner"), tag("measurement").alias("measurement"), tag("field").alias("field"), "value")


@query("s33_day_keys", "ticks", "SELECT exchange, symbol, seq, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST((epoch_us(ts) - epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP))) // 1000 AS BIGINT) AS ms FROM ticks")
def s33(t):
    return files.by_day(t).select("exchange", "symbol", "seq", F.col("date").cast("string").alias("date"), "ms")


@query("s34_between", "ticks", f"SELECT exchange, symbol, ts, seq, {P} AS price FROM ticks WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-12'")
def s34(t):
    return store.between(t, "2024-01-08", "2024-01-12").select("exchange", "symbol", "ts", "seq", F.col("price").cast("double").alias("price"))


@query("s37_universes", "ticks", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS members FROM ticks WHERE price > 130 GROUP BY 1")
def s37(t):
    x = t.where("price > 130").select(F.to_date("ts").cast("string").alias("date"), "symbol")
    return store.snapshots(x, "date", "symbol").withColumn("members", F.array_join("members", ","))


@query("s37_memberships", "ticks", """WITH m AS (SELECT DISTINCT CAST(ts AS DATE) AS d, exchange || ':' || symbol AS member FROM ticks WHERE price > 250), n AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM m)),
g AS (SELECT member, d, i - row_number() OVER (PARTITION BY member ORDER BY d) AS g FROM m JOIN n USING (d)) SELECT member, CAST(min(d) AS VARCHAR) AS since, CAST(max(d) AS VARCHAR) AS until FROM g GROUP BY member, g""")
def s37_spells(t):
    x = t.where("price > 250").select(F.to_date("ts").cast("string").alias("date"), F.concat_ws(":", "exchange", "symbol").alias("member"))
    return store.memberships(x, "date", "member")


@query("s38_factor_rows", "ticks", """WITH f AS (SELECT exchange, symbol, CAST(ts AS DATE) AS d, CAST(count(*) AS DOUBLE) AS factor FROM ticks WHERE side > 0 GROUP BY 1, 2, 3), k AS (SELECT exchange, symbol FROM f GROUP BY exchange, symbol HAVING min(factor) <> max(factor))
SELECT exchange, symbol, CAST(d AS VARCHAR) AS date, factor FROM f WHERE (exchange, symbol) IN (SELECT (exchange, symbol) FROM k) UNION ALL SELECT exchange, symbol, '2050-12-31', 1.0 FROM k""")
def s38(t):
    f = t.where("side > 0").groupBy("exchange", "symbol", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("factor"))
    return store.factor_rows(f, ["exchange", "symbol"], "date", "factor", "2050-12-31").withColumn("date", F.col("date").cast("string"))


@query("s40_first_per_key", "ticks", """WITH p AS (SELECT 0 AS p, CAST(price AS BIGINT) AS k, seq FROM ticks WHERE side > 0 UNION ALL SELECT 1, CAST(price AS BIGINT), seq FROM ticks WHERE side < 0) SELECT k, min((p, seq))[2] AS seq FROM p GROUP BY k""")
def s40(t):
    page = lambda s: t.where(F.col("side") == s).select(F.round("price").cast("long").alias("k"), "seq")
    return store.first_per_key([page(1), page(-1)], "k")


@query("s42_alias_rows", "ticks", "WITH d AS (SELECT DISTINCT exchange, CAST(ts AS DATE) AS d FROM ticks WHERE symbol = 'S1' AND price > 200) SELECT exchange, symbol, seq FROM ticks WHERE symbol <> 'S1' OR price > 200 UNION ALL SELECT exchange, 'S1', seq FROM ticks WHERE symbol = 'S0' AND (exchange, CAST(ts AS DATE)) NOT IN (SELECT (exchange, d) FROM d)")
def s42(t):
    return store.aliased_copy(t.where("symbol <> 'S1' OR price > 200"), "S0", "S1").select("exchange", "symbol", "seq")


@query("s43_normalisers", "ticks", f"SELECT 'price' AS col, CAST(min(price) AS DOUBLE) AS min, CAST(max(price) AS DOUBLE) AS max FROM ticks UNION ALL SELECT 'size', CAST(min(size) AS DOUBLE), CAST(max(size) AS DOUBLE) FROM ticks")
def s43(t):
    """A store of extremes made of one part of the rows and brought up to date with the other."""
    part = lambda s: store.normaliser(t.where(F.col("side") == s), ["price", "size"])
    return store.widened(part(1), part(-1))
