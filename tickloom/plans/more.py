"""Queries over the order book, named curves, the series registry, gaps around changes and full evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import views
from tickloom.functions import curves, scalars
from tickloom.operators import bars, book, joins, store, windows
from tickloom.plans.features import HOURLY, PRED, TRIPS, hourly, ledger
from tickloom.plans.registry import query, rounded, table_query
from tickloom.plans.selection import HOURS, hours
from tickloom.plans.series import W, r

N = 3
_SIDE = "CASE WHEN size > 0 THEN 1 ELSE -1 END"
_LEVEL = "CAST(abs(round(CAST((price - 110) / 0.5 AS DOUBLE))) + 1 AS INT)"
_NAMES = [(s, v, k) for s, v in (("bid", 1), ("ask", -1)) for k in range(1, N + 1)]
_PER = ", ".join(f"arg_max(CAST(size AS DOUBLE), seq) FILTER (side = {v} AND level = {k}) AS {s}_{k}s, arg_max(CAST(count AS DOUBLE), seq) FILTER (side = {v} AND level = {k}) AS {s}_{k}c" for s, v, k in _NAMES)
_CARRIED = ", ".join(f"last_value({s}_{k}{x} IGNORE NULLS) OVER (PARTITION BY exchange, symbol ORDER BY ts) AS {s}_{k}{x}" for s, _, k in _NAMES for x in "sc")
_BEGUN = ", ".join(f"min(ts) FILTER ({s}_{k}s IS NOT NULL)" for s, _, k in _NAMES)
LEVELS = f"""u AS (SELECT exchange, symbol, ts, seq, {_SIDE} AS side, {_LEVEL} AS level, size, count FROM l2), per AS (SELECT exchange, symbol, ts, {_PER} FROM u WHERE level <= {N} GROUP BY exchange, symbol, ts),
bg AS (SELECT exchange, symbol, greatest({_BEGUN}) AS f FROM per GROUP BY exchange, symbol), ca AS (SELECT exchange, symbol, ts, {_CARRIED} FROM per),
lv AS (SELECT exchange, symbol, ts, {', '.join(f'coalesce({s}_{k}{x}, 0) AS {s}_{k}{x}' for s, _, k in _NAMES for x in 'sc')} FROM ca JOIN bg USING (exchange, symbol) WHERE ts >= f)"""


def updates(b):
    level = (F.abs(F.round((F.col("price").cast("double") - 110) / 0.5)) + 1).cast("int")
    return b.select("exchange", "symbol", "ts", "seq", F.when(F.col("size") > 0, 1).otherwise(-1).alias("side"), level.alias("level"), "size", "count")


@query("b06_book_levels", "l2", f"WITH {LEVELS} SELECT * FROM lv")
def b06(b):
    x = book.book_levels(updates(b), N)
    return x.select("exchange", "symbol", "ts", *[F.col(f"{s}_{k}.{w}").alias(f"{s}_{k}{w[0]}") for s, _, k in _NAMES for w in ("size", "count")])


def _weighted(side: str, x: str) -> str:
    return " + ".join(f"abs({side}_{k}{x}) * {(1 - 2 / (N + 1)) ** (k - 1)!r}" for k in range(1, N + 1))


_FIX = ", ".join(f"CASE WHEN {s}{x} = 0 THEN m{x} ELSE {s}{x} END AS {s}{x}" for s in ("bid", "ask") for x in "sc")
IMBALANCE = f"""{LEVELS}, su AS (SELECT exchange, symbol, ts, {', '.join(f'{_weighted(s, x)} AS {s}{x}' for s in ('bid', 'ask') for x in 'sc')} FROM lv),
mi AS (SELECT exchange, symbol, {', '.join(f'least(min(bid{x}) FILTER (bid{x} > 0), min(ask{x}) FILTER (ask{x} > 0)) AS m{x}' for x in 'sc')} FROM su GROUP BY exchange, symbol),
fx AS (SELECT exchange, symbol, ts, {_FIX} FROM su JOIN mi USING (exchange, symbol)),
im AS (SELECT exchange, symbol, ts, greatest(asks / bids, 1 / (asks / bids)) AS steps, greatest(asks / bids, 1 / (asks / bids)) * CASE WHEN asks > bids THEN -1 ELSE 1 END AS size_ratio,
greatest(askc / bidc, 1 / (askc / bidc)) * CASE WHEN asks > bids THEN -1 ELSE 1 END AS count_ratio, bids - asks AS size_net, askc - bidc AS count_net FROM fx)"""


@query("b08_published_imbalance", "l2", f"""WITH RECURSIVE {IMBALANCE}, i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY ts) AS i FROM im),
r AS (SELECT exchange, symbol, i, steps AS kept, true AS k FROM i WHERE i = 1 UNION ALL SELECT i.exchange, i.symbol, i.i, CASE WHEN abs(i.steps - r.kept) >= 0.5 THEN i.steps ELSE r.kept END, abs(i.steps - r.kept) >= 0.5
FROM r JOIN i ON i.exchange = r.exchange AND i.symbol = r.symbol AND i.i = r.i + 1),
k AS (SELECT i.* FROM i JOIN r USING (exchange, symbol, i) WHERE r.k)
SELECT exchange, symbol, ts, information, round(value, 6) + 0.0 AS value FROM (UNPIVOT k ON size_ratio, count_ratio, size_net, count_net INTO NAME information VALUE value)""")
def b08(b):
    return rounded(book.published_imbalance(book.book_imbalance(book.book_levels(updates(b), N), N), 0.5))


_QT = f"""c AS (SELECT exchange, symbol, ts, CAST(floor(sum(CAST(price * size AS DECIMAL(38,10))) OVER ({W}) / 5000) AS BIGINT) AS k FROM ticks),
e AS (SELECT exchange, symbol, k AS volume_tick, max(ts) AS ts FROM c GROUP BY exchange, symbol, k),
q AS (SELECT q.exchange, q.symbol, q.ts, q.seq, q.bid, q.ask, q.bid_size, q.ask_size, e.volume_tick FROM quotes q ASOF JOIN e ON q.exchange = e.exchange AND q.symbol = e.symbol AND q.ts <= e.ts),
d AS (SELECT *, {', '.join(f'CASE WHEN {s} = lag({s}) OVER ({W}) THEN {s}_size - lag({s}_size) OVER ({W}) ELSE 0 END AS d{s}' for s in ('bid', 'ask'))} FROM q)"""
_OHLC = ", ".join(f"{r(f'arg_min({c}, (ts, seq))', f'{c}_open')}, {r(f'max({c})', f'{c}_high')}, {r(f'min({c})', f'{c}_low')}, {r(f'arg_max({c}, (ts, seq))', f'{c}_close')}" for c in ("bid", "bid_size", "ask", "ask_size"))
_FLOW = ", ".join(f"CAST(coalesce(sum(-d{s}) FILTER (d{s} < 0), 0) AS BIGINT) AS {s}_size_removed, count(*) FILTER (d{s} < 0) AS {s}_size_removed_count, CAST(coalesce(sum(d{s}) FILTER (d{s} > 0), 0) AS BIGINT) AS {s}_size_added, count(*) FILTER (d{s} > 0) AS {s}_size_added_count" for s in ("bid", "ask"))


@table_query("g09_quote_tick_bars", f"WITH {_QT} SELECT exchange, symbol, volume_tick, max(ts) AS ts, {_OHLC}, {_FLOW}, {r('max(ask - bid)', 'spread_high')}, {r('min(ask - bid)', 'spread_low')} FROM d GROUP BY exchange, symbol, volume_tick")
def g09(spark, sf_dir):
    """Quote bars on the volume ticks of the deals."""
    t, q = (views.frame(spark, sf_dir, v) for v in (views.TICKS, views.QUOTES))
    ends = bars.dollar_bars(t, 5000).select("exchange", "symbol", "ts", "volume_tick")
    out = book.quote_tick_bars(joins.interval_bin(q, ends, ["exchange", "symbol"], "volume_tick"))
    sizes = [f"{s}_size_{c}" for s in ("bid", "ask") for c in ("removed", "added")]
    prices = [f"{c}_{x}" for c in ("bid_size", "ask_size") for x in ("open", "high", "low", "close")]
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in sizes} | {c: F.col(c).cast("double") for c in prices}))


_F = ["spread", "spread_max", "mid", "bought", "sold", "n"]


@table_query("b13_scaled_features", f"""WITH q AS (SELECT exchange, symbol, date_trunc('hour', ts) AS ts, CAST(arg_max(ask - bid, (ts, seq)) AS DOUBLE) AS spread, CAST(max(ask - bid) AS DOUBLE) AS spread_max, CAST(arg_max((bid + ask) / 2, (ts, seq)) AS DOUBLE) AS mid FROM quotes GROUP BY 1, 2, 3),
t AS (SELECT exchange, symbol, date_trunc('hour', ts) AS ts, CAST(sum(CASE WHEN side > 0 THEN size ELSE 0 END) AS DOUBLE) AS bought, CAST(sum(CASE WHEN side > 0 THEN 0 ELSE size END) AS DOUBLE) AS sold, CAST(count(*) AS DOUBLE) AS n FROM ticks GROUP BY 1, 2, 3),
b AS (SELECT * FROM q JOIN t USING (exchange, symbol, ts)), m AS (SELECT {', '.join(f'min({c}) AS {c}_a, max({c}) AS {c}_z' for c in _F)} FROM b)
SELECT exchange, symbol, ts, {', '.join(f'coalesce(round(({c} - {c}_a) / nullif({c}_z - {c}_a, 0), 3), 0) + 0.0 AS {c}' for c in _F)} FROM b, m""")
def b13(spark, sf_dir):
    """Compared as shares of three places: a code is cut, not rounded, so one unit of its last place depends on the last bit."""
    t, q = (views.frame(spark, sf_dir, v) for v in (views.TICKS, views.QUOTES))
    out = book.quote_and_fill_features(q, t, "1 hour", digits=9)
    return out.select("exchange", "symbol", "ts", *[(F.round(F.col(c) / 1e9, 3) + 0.0).alias(c) for c in _F])


_GAP = 10


@query("w19_rows_around_changes", "ticks", f"""WITH a AS (SELECT exchange, symbol, ts, seq, floor(CAST(price AS DOUBLE) / 200) AS v FROM ticks),
k AS (SELECT *, row_number() OVER ({W}) - 1 AS ix, coalesce(v <> lag(v) OVER ({W}), false) OR coalesce(lead(v) OVER ({W}) <> v, false) AS k FROM a),
l AS (SELECT *, last_value(CASE WHEN k THEN ix END IGNORE NULLS) OVER ({W}) AS p, first_value(CASE WHEN k THEN ix END IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z, max(CASE WHEN k THEN ix END) OVER (PARTITION BY exchange, symbol) AS m FROM k)
SELECT exchange, symbol, ts, seq, ix FROM l WHERE (k AND ix < m) OR (NOT k AND z - p >= {_GAP} AND (ix - p) % {_GAP} = 0 AND ix < z)""")
def w19(t):
    x = t.withColumn("v", F.floor(F.col("price").cast("double") / 200))
    return book.with_changes(x, "v", _GAP).select("exchange", "symbol", "ts", "seq", "ix")


_STEPS = [int(1 + i**2.5) for i in range(5)]


@query("w20_ratio_changes", "ticks", f"""WITH {HOURS}, j AS (SELECT x.exchange, x.symbol AS a, y.symbol AS b, x.ts, x.close / y.close AS ratio FROM h x JOIN h y ON x.exchange = y.exchange AND x.ts = y.ts AND x.symbol < y.symbol),
d AS (SELECT exchange, a, b, ts, row_number() OVER w AS i, {', '.join(f'ratio - lag(ratio, {n}) OVER w AS ratio_d_{n}' for n in _STEPS)}, avg(ratio) OVER (PARTITION BY exchange, a, b ORDER BY ts ROWS 4 PRECEDING) AS ratio_mean FROM j WINDOW w AS (PARTITION BY exchange, a, b ORDER BY ts))
SELECT exchange, a, b, ts, {', '.join(f'round(ratio_d_{n}, 6) + 0.0 AS ratio_d_{n}' for n in _STEPS)}, round(ratio_mean, 6) + 0.0 AS ratio_mean FROM d WHERE i > {max(_STEPS)}""")
def w20(t):
    from tickloom.operators import selection

    pairs = selection.pairs_of(hours(t), ["exchange", "ts"], "symbol", "close")
    return rounded(book.ratio_changes(pairs, ["exchange", "a", "b"], _STEPS, 5))


_WIDE = [1 << k for k in range(15)]
_WSQL = ", ".join(f"CASE WHEN count(price) OVER ({W} ROWS {n - 1} PRECEDING) = {n} THEN round({a}(price) OVER ({W} ROWS {n - 1} PRECEDING), 6) END AS price_{a}_{n}" for n in _WIDE for a in ("sum", "max", "min"))


@query("w02_upsample_wide", "holes", f"SELECT exchange, symbol, ts, seq, {_WSQL} FROM holes WHERE price IS NOT NULL")
def w02_wide(h):
    """Windows of 2^0 to 2^14 rows."""
    up = windows.upsample(h, "price", _WIDE, ("sum", "max", "min"))
    return rounded(up.select("exchange", "symbol", "ts", "seq", *[f"price_{a}_{n}" for n in _WIDE for a in ("sum", "max", "min")]))


# ---- curves and store --------------------------------------------------------------------------------------


_CHAIN = f"""WITH a AS (SELECT exchange, symbol, ts, seq, CAST(price AS DOUBLE) AS p, CAST(price AS DOUBLE) - lag(CAST(price AS DOUBLE)) OVER ({W}) AS d FROM ticks)"""


@query("u04_chained_curves", "ticks", f"""{_CHAIN} SELECT exchange, symbol, ts, seq, CASE WHEN count(d) OVER ({W} ROWS 3 PRECEDING) = 4 THEN round(avg(d) OVER ({W} ROWS 3 PRECEDING), 6) + 0.0 END AS smooth, round(abs(d), 6) + 0.0 AS size_of_step FROM a""")
def u04(t):
    x = curves.piped(t, lambda d: d.withColumn("price", F.col("price").cast("double")), lambda d: curves.with_curves(d, ["price|diff-1|mean-4", "price|diff-1|abs"]))
    return rounded(x.select("exchange", "symbol", "ts", "seq", F.col("`price|diff-1|mean-4`").alias("smooth"), F.col("`price|diff-1|abs`").alias("size_of_step")))


@query("u05_missing_curves", "ticks", f"""{_CHAIN} SELECT exchange, symbol, ts, seq, round(p, 6) AS price, CASE WHEN count(*) OVER ({W} ROWS 4 PRECEDING) = 5 THEN round(max(2 * p) OVER ({W} ROWS 4 PRECEDING), 6) END AS top FROM a""")
def u05(t):
    """A column that is there is taken as it is; only what is missing is computed, from the longest part that is there."""
    x = t.withColumn("price", F.col("price").cast("double")).withColumn("price|twice", 2 * F.col("price"))
    x = curves.with_curves(x, ["price", "price|twice|top-5"])
    return rounded(x.select("exchange", "symbol", "ts", "seq", "price", F.col("`price|twice|top-5`").alias("top")))


_TAGS = """'{"asset":"' || symbol || '","exchange":"' || exchange || '","measurement":"bars","side":"' || side || '"}'"""


@query("s20_registry", "ticks", f"WITH {HOURLY} SELECT DISTINCT md5({_TAGS}) AS id, {_TAGS} AS tags FROM h WHERE side = '1' OR symbol = 'S0'")
def s20(t):
    """Series registered in two goes, those of sales but for one symbol taken out again."""
    h = hourly(t)
    book_ = store.registered(store.registered(None, h.where(F.col("tags")["side"] == "1")), h)
    out = h.where((F.col("tags")["side"] == "-1") & (F.col("tags")["asset"] != "S0")).select(store.series_id().alias("id"))
    return store.deregistered(book_, out)


@query("s22_dropped_series", "ticks", f"WITH {HOURLY} SELECT exchange, symbol AS asset, side, count(*) AS n FROM h WHERE NOT (exchange = 'X' AND symbol = 'S1' AND side = '1') AND md5({_TAGS}) <> md5('{{\"asset\":\"S2\",\"exchange\":\"Y\",\"measurement\":\"bars\",\"side\":\"-1\"}}') GROUP BY ALL")
def s22(t):
    """One series dropped by its tags, one by its key."""
    import hashlib

    key = hashlib.md5(b'{"asset":"S2","exchange":"Y","measurement":"bars","side":"-1"}').hexdigest()
    left = store.dropped(store.dropped(hourly(t), {"measurement": "bars", "asset": "S1", "exchange": "X", "side": "1"}), key=key)
    tag = lambda k: F.col("tags")[k]
    return left.groupBy(tag("exchange").alias("exchange"), tag("asset").alias("asset"), tag("side").alias("side")).agg(F.count(F.lit(1)).alias("n"))


_NAMED = ", ".join(f"max(value) FILTER (symbol = 'S{i}' AND exchange = '{x}') AS \"asset-S{i}|exchange-{x}|measurement-bars|side-1\"" for i in range(5) for x in "XY")


@query("s24_wide", "ticks", f"WITH {HOURLY} SELECT ts, {_NAMED} FROM h WHERE side = '1' GROUP BY ts")
def s24(t):
    """All series of one side, side by side; without `more` several series are an error."""
    return store.wide(hourly(t), {"measurement": "bars", "side": "1"}, more=True)


@query("s41_keep_if_better", "ticks", """WITH o AS (SELECT exchange, symbol, CAST(isodow(ts) AS INT) AS day, max(CAST(price AS DOUBLE)) AS profit FROM ticks WHERE seq % 2 = 0 GROUP BY 1, 2, 3), n AS (SELECT exchange, symbol, CAST(isodow(ts) AS INT) AS day, max(CAST(price AS DOUBLE)) AS profit FROM ticks WHERE seq % 2 = 1 GROUP BY 1, 2, 3)
SELECT exchange, symbol, day, CASE WHEN o.profit IS NULL OR n.profit > o.profit THEN n.profit ELSE o.profit END AS profit, CASE WHEN o.profit IS NULL OR n.profit > o.profit THEN 'new' ELSE 'stored' END AS params FROM o FULL JOIN n USING (exchange, symbol, day)""")
def s41(t):
    """Stored parameters meet new ones: a new one stays only where it earns more."""
    x = t.withColumn("day", (F.weekday("ts") + 1).cast("int"))
    part = lambda k, name: x.where(F.col("seq") % 2 == k).groupBy("exchange", "symbol", "day").agg(F.max("price").cast("double").alias("profit")).withColumn("params", F.lit(name))
    return store.keep_if_better(part(0, "stored"), part(1, "new"), ["exchange", "symbol", "day"], "profit")


# ---- evaluation and deals ----------------------------------------------------------------------------------


@query("p01_measures", "ticks", f"SELECT exchange, symbol, ts, seq, side AS tick, {r('side * size', 'sym')}, {r('side * size * price', 'usd')}, {r('side * CAST(size AS DOUBLE) / CAST(price AS DOUBLE)', 'xbt')} FROM ticks")
def p01(t):
    return rounded(t.select("exchange", "symbol", "ts", "seq", *[scalars.measurable(u).alias(u) for u in ("tick", "sym", "usd", "xbt")]))


@table_query("a06_numbers", """SELECT event_id, list_min(xs) AS least, CAST(len(xs) AS INT) AS n FROM (SELECT event_id, list_filter(list_transform([CAST(user_id AS VARCHAR), event_type, CAST(event_id % 7 AS VARCHAR), ''], lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x IS NOT NULL) AS xs FROM events)""")
def a06(spark, sf_dir):
    """Numbers among texts, and the least of them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    texts = F.array(F.col("user_id").cast("string"), F.col("event_type"), (F.col("event_id") % 7).cast("string"), F.lit(""))
    x = e.withColumn("texts", texts).withColumn("xs", scalars.numbers("texts"))
    return x.select("event_id", F.array_min("xs").alias("least"), F.size("xs").alias("n"))


@table_query("l16_scores", f"""WITH p AS (SELECT event_id, y, p >= 0.1 AS h, coalesce(lag(p >= 0.1) OVER (PARTITION BY event_id // 1000 ORDER BY event_id), false) AS b FROM ({PRED})),
s AS (SELECT count(*) FILTER (y AND h) AS tp, count(*) FILTER (NOT y AND h) AS fp, count(*) FILTER (y AND NOT h) AS fn, count(*) FILTER (NOT y AND NOT h) AS tn, count(*) FILTER (h AND NOT b AND y) AS ftp, count(*) FILTER (h AND NOT b) AS ff FROM p)
SELECT tp + fp AS positives, fn + tn AS negatives, {r('(tp + tn) / (tp + tn + fp + fn)', 'accuracy')}, {r('tp / nullif(tp + fp, 0)', 'precision')}, {r('tp / (tp + fn)', 'recall')}, {r('2 * tp / (2 * tp + fp + fn)', 'f1')}, ff AS first_positives, {r('ftp / nullif(ff, 0)', 'first_precision')} FROM s""")
def l16(spark, sf_dir):
    """Scores of a classifier; a first prediction is one that follows no other, inside each thousand of rows."""
    from tickloom.operators import evaluation

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select("event_id", F.floor(F.col("event_id") / 1000).alias("part"), (F.col("value") / 500 >= 0.1).alias("hit"), (F.col("event_type") == "purchase").alias("y"))
    return rounded(evaluation.classifier_scores(rows, "y", "hit", ["part"], ["event_id"]))


_DAYS_OF = TRIPS.replace("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderdate AS day").replace("SELECT o_custkey, n, CAST((price", "SELECT o_custkey, n, date_diff('day', lag(day) OVER w, day) AS days, 0.001 * CAST(price + lag(price) OVER w AS DOUBLE) AS fee, CAST((price")


@table_query("x14_summary", f"""WITH {_DAYS_OF} SELECT o_custkey, count(*) AS trips, {r('sum(profit)', 'profit')}, {r('sum(fee)', 'fees')}, {r('avg(days)', 'mean_days')}, CAST(max(days) AS INT) AS most_days, {r('max(profit)', 'best')}, {r('min(profit)', 'worst')} FROM t WHERE n % 2 = 0 GROUP BY o_custkey""")
def x14(spark, sf_dir):
    """Totals, fees and durations of each customer's round trips."""
    from tickloom.operators import trades

    g = ledger(spark, sf_dir).withColumn("price", F.col("price").cast("double"))
    return rounded(trades.trip_summary(g, "o_custkey", "n", "price", "direction", "o_orderdate", 0.001))


@table_query("x16_wins", f"""WITH {TRIPS} SELECT o_custkey, count(*) FILTER (profit > 0) AS wins, count(*) FILTER (profit <= 0) AS losses, {r('count(*) FILTER (profit > 0) / count(*)', 'win_ratio')}, string_agg(CASE WHEN profit > 0 THEN 'w' ELSE 'l' END, '' ORDER BY n) AS outcomes FROM t WHERE n % 2 = 0 GROUP BY o_custkey""")
def x16(spark, sf_dir):
    """Wins and losses in order, and their ratio."""
    from tickloom.operators import trades

    g = ledger(spark, sf_dir).withColumn("price", F.col("price").cast("double"))
    return rounded(trades.wins(trades.round_trips(g, "o_custkey", "n", "price", "direction", 0.001), "o_custkey", "n"))
