"""Queries over entries, held rows, exits and fills."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom import views
from tickloom.operators import bars, exits, held, trades
from tickloom.plans.features import LEDGER, TRIPS, ledger
from tickloom.plans.registry import query, rounded, table_query

#: Two strategies on the canonical ticks, whose prices start at 100 and thin out upwards.
LOW, HIGH = 102, 280
ENTRIES = f"""e AS (SELECT seq AS id, exchange, symbol, ts, ts + INTERVAL 2 HOUR AS "end", CAST(price AS DOUBLE) AS p0,
CASE WHEN price <= {LOW} THEN 1 ELSE -1 END AS direction FROM ticks WHERE price <= {LOW} OR price >= {HIGH})"""
HELD = ENTRIES + """, h AS (SELECT e.id, e.exchange, e.symbol, e.p0, e.direction, e.ts AS entry_ts, c.ts, c.seq, c.side, c.size,
(CAST(c.price AS DOUBLE) - p0) * e.direction AS profit FROM e JOIN ticks c ON c.exchange = e.exchange AND c.symbol = e.symbol AND c.ts > e.ts AND c.ts <= e."end"),
c AS (SELECT *, greatest(max(profit) OVER w, 0.0) AS best, greatest(max(profit) OVER w, 0.0) - profit AS giveback FROM h WINDOW w AS (PARTITION BY id ORDER BY ts, seq))"""


def entries(t):
    p = F.col("price")
    found = exits.select_entries(t, {"dip": (1, {"all": [p <= LOW]}), "peak": (-1, {"all": [p >= HIGH]})}, 120)
    return found.select(F.col("seq").alias("id"), "exchange", "symbol", "ts", "end", p.cast("double").alias("p0"), "direction")


def curve_of(t):
    return t.select("exchange", "symbol", "ts", "seq", F.col("price").cast("double").alias("price"), "side", F.col("size").cast("double").alias("size"))


def found(t, rules, left_out=None):
    return held.exits_in_blocks(entries(t), curve_of(t), ["exchange", "symbol"], rules, left_out)


def curves(t, keep, made):
    """A row for each row that a deal holds, made in blocks: only deals and ticks are shuffled."""
    return held.curves_in_blocks(entries(t), t.withColumn("price", F.col("price").cast("double")), ["exchange", "symbol"], ["ts", "seq", *keep], made)


@query("x01_entries", "ticks", """WITH a AS (SELECT exchange, symbol, ts, seq, price <= 105 AS low, size >= 4 AS big, side > 0 AS buy, price >= 250 AS high FROM ticks),
s AS (SELECT exchange, symbol, ts, seq, 'big-dip' AS strategy, 1 AS direction FROM a WHERE low AND big UNION ALL SELECT exchange, symbol, ts, seq, 'extreme', 1 FROM a WHERE (low OR high) UNION ALL SELECT exchange, symbol, ts, seq, 'sold-peak', -1 FROM a WHERE high AND NOT buy)
SELECT exchange, symbol, ts, seq, strategy, direction FROM s""")
def x01(t):
    low, high, big, buy = F.col("price") <= 105, F.col("price") >= 250, F.col("size") >= 4, F.col("side") > 0
    rules = {"big-dip": (1, {"all": [low, big]}), "extreme": (1, {"any": [low, high]}), "sold-peak": (-1, {"all": [high], "none": [buy]})}
    return exits.select_entries(t, rules, 120).select("exchange", "symbol", "ts", "seq", "strategy", "direction")


@query("j11_merged_entries", "ticks", """WITH a AS (SELECT exchange, symbol, ts, seq, price <= 105 AS low, size >= 4 AS big FROM ticks)
SELECT exchange, symbol, ts, seq, CASE WHEN low AND big THEN 'big,dip' WHEN low THEN 'dip' ELSE 'big' END AS strategies FROM a WHERE low OR big""")
def j11(t):
    rules = {"dip": (1, {"all": [F.col("price") <= 105]}), "big": (1, {"all": [F.col("size") >= 4]})}
    found = exits.merged_entries(exits.select_entries(t, rules, 120), ["exchange", "symbol", "ts", "seq"])
    return found.withColumn("strategies", F.array_join("strategies", ","))


@query("x02_deal_curves", "ticks", f"""WITH {HELD} SELECT id, ts, seq, round(profit, 6) + 0.0 AS profit, round(profit / p0, 6) + 0.0 AS profit_rel, round(best, 6) + 0.0 AS best,
round(giveback, 6) + 0.0 AS giveback, round((epoch_us(ts) - epoch_us(entry_ts)) / 60e6, 6) + 0.0 AS elapsed FROM c""")
def x02(t):
    return rounded(curves(t, [], ["profit", "profit_rel", "best", "giveback", "elapsed"]))


@query("x03_first_exits", "ticks", f"""WITH {HELD}, f AS (SELECT id, min(ts) FILTER (profit >= 40) AS target_ts, min(ts) FILTER (profit <= -25) AS stop_ts, min(ts) FILTER (giveback >= 30) AS trail_ts, max((ts, seq)) AS z,
min((ts, seq)) FILTER (profit >= 40) AS a, min((ts, seq)) FILTER (profit <= -25) AS b, min((ts, seq)) FILTER (giveback >= 30) AS c FROM c GROUP BY id),
g AS (SELECT *, least(a, b, c, z) AS x FROM f)
SELECT id, target_ts, stop_ts, trail_ts, x[1] AS exit_ts, x[2] AS exit_seq, CASE WHEN a = x THEN 'target' WHEN b = x THEN 'stop' WHEN c = x THEN 'trail' ELSE 'timeout' END AS reason FROM g""")
def x03(t):
    """First-touch exits, with the timeout (X09) and the reason by order of rules (X12)."""
    rules = {"target": lambda d: d.at_least(40.0), "stop": lambda d: d.at_most(-25.0), "trail": lambda d: d.gives_back(30.0)}
    return held.earliest(found(t, rules), list(rules))


@query("x04_vetoed_exits", "ticks", f"""WITH {HELD}, v AS (SELECT * FROM c WHERE NOT (side = direction AND size >= 5))
SELECT id, min(ts) FILTER (profit <= -25) AS stop_ts, coalesce(min(ts) FILTER (profit <= -25), max(ts)) AS exit_ts FROM v GROUP BY id""")
def x04(t):
    """Large flow in the deal's direction vetoes an exit at its row."""
    veto = lambda rows, direction: (rows["side"] == direction) & (rows["size"] >= 5)
    return held.earliest(found(t, {"stop": lambda d: d.at_most(-25.0)}, veto), ["stop"]).select("id", "stop_ts", "exit_ts")


@query("x05_compound_exits", "ticks", f"""WITH {HELD}, m AS (SELECT *, min(profit) OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) AS low FROM c)
SELECT id, min(ts) FILTER (low >= 0) AS safe_ts, min(ts) FILTER (best >= 20 AND profit <= best / 2) AS given_back_ts FROM m GROUP BY id""")
def x05(t):
    rules = {"safe": lambda d: d.stays_above_water(), "given_back": lambda d: d.halves(20.0)}
    return held.earliest(found(t, rules), list(rules)).select("id", "safe_ts", "given_back_ts")


def _minute_bars(spark, sf_dir):
    """Deal and quote bars of 10 minutes where both exist."""
    t, q = (views.frame(spark, sf_dir, v) for v in (views.TICKS, views.QUOTES))
    both = bars.time_bars(t, "10 minutes").join(bars.quote_bars(q, "10 minutes"), ["exchange", "symbol", "ts"])
    doubles = ["high", "low", "close", "bid_high", "bid_low", "bid_close", "ask_high", "ask_low", "ask_close"]
    return both.select("exchange", "symbol", "ts", *[F.col(c).cast("double").alias(c) for c in doubles])


BARS = """tb AS (SELECT exchange, symbol, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, CAST(max(price) AS DOUBLE) AS high, CAST(min(price) AS DOUBLE) AS low, CAST(last(price ORDER BY ts, seq) AS DOUBLE) AS close FROM ticks GROUP BY 1, 2, 3),
qb AS (SELECT exchange, symbol, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, CAST(max(bid) AS DOUBLE) AS bid_high, CAST(min(bid) AS DOUBLE) AS bid_low, CAST(last(bid ORDER BY ts, seq) AS DOUBLE) AS bid_close,
CAST(max(ask) AS DOUBLE) AS ask_high, CAST(min(ask) AS DOUBLE) AS ask_low, CAST(last(ask ORDER BY ts, seq) AS DOUBLE) AS ask_close FROM quotes GROUP BY 1, 2, 3), b AS (SELECT * FROM tb JOIN qb USING (exchange, symbol, ts))"""


@table_query("x10_market_fills", f"WITH {BARS} SELECT exchange, symbol, ts, round(greatest(ask_high, high), 6) + 0.0 AS buy, round(least(bid_low, low), 6) + 0.0 AS sell FROM b")
def x10(spark, sf_dir):
    b = _minute_bars(spark, sf_dir)
    return rounded(b.select("exchange", "symbol", "ts", exits.market_fill(b, F.lit(1)).alias("buy"), exits.market_fill(b, F.lit(-1)).alias("sell")))


@table_query("x11_limit_fills", f"""WITH {BARS}, o AS (SELECT exchange, symbol, ts, ts + INTERVAL 6 HOUR AS "end", d AS direction, CASE WHEN d > 0 THEN bid_close - bid_close * 0.02 ELSE ask_close + ask_close * 0.02 END AS lim, epoch_us(ts) // 1000000 * 10 + CASE WHEN d > 0 THEN 1 ELSE 0 END AS k FROM b, (SELECT unnest([1, -1]) AS d)),
r AS (SELECT o.exchange, o.symbol, k, direction, lim, b.*, CASE WHEN direction > 0 THEN least(ask_low, low) < lim ELSE greatest(bid_high, high) > lim END AS touch,
CASE WHEN direction > 0 THEN least(ask_high, lim) ELSE greatest(bid_low, lim) END AS p, CASE WHEN direction > 0 THEN bid_high >= lim + 1.0 ELSE ask_low <= lim - 1.0 END AS away
FROM o JOIN b ON b.exchange = o.exchange AND b.symbol = o.symbol AND b.ts > o.ts AND b.ts <= o."end"),
f AS (SELECT exchange, symbol, k, min(ts) FILTER (touch) AS ft, arg_min(p, ts) FILTER (touch) AS fp, max(ts) AS lt, any_value(lim) AS lp, min(ts) FILTER (away) AS c FROM r GROUP BY exchange, symbol, k)
SELECT exchange || '-' || symbol || '-' || k AS id, coalesce(ft, lt) AS fill_ts, round(coalesce(fp, lp), 6) + 0.0 AS fill_price, ft IS NOT NULL AS touched, CASE WHEN c < coalesce(ft, lt) THEN c END AS cancel_ts FROM f""")
def x11(spark, sf_dir):
    """A buy and a sale limit order at every bar, 2 % from the near side, alive for 6 hours; cancellation is X13."""
    b = _minute_bars(spark, sf_dir)
    d = F.col("direction")
    o = b.select("exchange", "symbol", "ts", "bid_close", "ask_close", F.explode(F.array(F.lit(1), F.lit(-1))).alias("direction"))
    o = o.select(
        F.concat("exchange", F.lit("-"), "symbol", F.lit("-"), F.unix_timestamp("ts") * 10 + F.when(d > 0, 1).otherwise(0)).alias("id"), "exchange", "symbol", "ts",
        (F.col("ts") + F.expr("INTERVAL 6 HOUR")).alias("end"), "direction",
        F.when(d > 0, F.col("bid_close") - F.col("bid_close") * 0.02).otherwise(F.col("ask_close") + F.col("ask_close") * 0.02).alias("limit"),
    )
    return rounded(exits.limit_fills(o, b, ["exchange", "symbol"], 0.5))


@table_query("x15_running_profit", f"WITH {TRIPS} SELECT o_custkey, n, round(sum(profit) OVER (PARTITION BY o_custkey ORDER BY n), 6) + 0.0 AS total FROM t WHERE n % 2 = 0")
def x15(spark, sf_dir):
    g = ledger(spark, sf_dir).withColumn("price", F.col("price").cast("double"))
    e = trades.equity(trades.round_trips(g, "o_custkey", "n", "price", "direction", 0.001), "o_custkey", "n")
    return rounded(e.select("o_custkey", "n", "total"))


@query("x20_tick_profit", "ticks", f"WITH {HELD} SELECT id, ts, seq, round(profit - coalesce(lag(profit) OVER (PARTITION BY id ORDER BY ts, seq), 0), 6) + 0.0 AS pnl FROM c")
def x20(t):
    return rounded(curves(t, [], ["gain"]).withColumnRenamed("gain", "pnl"))


@table_query("x22_duration_buffer", """WITH g AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS days FROM orders)
SELECT o_custkey, n, round(1.5 * quantile_cont(CAST(days AS DOUBLE), 0.9) OVER (PARTITION BY o_custkey ORDER BY n ROWS 29 PRECEDING), 6) AS buffer FROM g WHERE days IS NOT NULL""")
def x22(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("n")
    g = ledger(spark, sf_dir).withColumn("days", F.datediff("o_orderdate", F.lag("o_orderdate").over(w))).where(F.col("days").isNotNull())
    last = F.sort_array(F.collect_list(F.col("days").cast("double")).over(w.rowsBetween(-29, 0)))
    at = (F.size(last) - 1) * F.lit(0.9)
    lo = F.floor(at).cast("int")
    value = F.get(last, lo) + (F.get(last, F.ceil(at).cast("int")) - F.get(last, lo)) * (at - lo)
    return rounded(g.select("o_custkey", "n", (1.5 * value).alias("buffer")))


@query("x25_parameter_sweep", "ticks", f"""WITH {HELD}, p AS (SELECT unnest([20.0, 40.0, 60.0, 80.0])::DOUBLE AS param),
f AS (SELECT param, id, arg_min(profit, (ts, seq)) FILTER (profit >= param) AS hit, arg_max(profit, (ts, seq)) AS final FROM c, p GROUP BY param, id)
SELECT param, round(sum(coalesce(hit, final)), 4) + 0.0 AS total, count(*) AS trades FROM f GROUP BY param""")
def x25(t):
    params = [20.0, 40.0, 60.0, 80.0]
    rows = found(t, {f"p{i}": (lambda d, p=p: d.at_least(p)) for i, p in enumerate(params)})
    each = F.array(*[F.struct(F.lit(p).alias("param"), F.coalesce(F.col(f"p{i}")["profit"], F.col("last")["profit"]).alias("profit")) for i, p in enumerate(params)])
    out = rows.select(F.inline(each)).groupBy("param").agg(F.sum("profit").alias("total"), F.count("profit").alias("trades"))
    return out.select("param", (F.round("total", 4) + 0.0).alias("total"), "trades")


@table_query("x26_portfolio_side", f"""WITH {LEDGER}, s AS (SELECT o_custkey, n, direction, CASE WHEN n % 5 = 0 THEN 0 ELSE direction END AS side FROM g)
SELECT o_custkey, n, side, coalesce(lag(side) OVER (PARTITION BY o_custkey ORDER BY n), 0) <> direction AS may_enter FROM s""")
def x26(spark, sf_dir):
    """Every fifth order of a customer counts as a stop."""
    out = exits.portfolio_side(ledger(spark, sf_dir), "o_custkey", "n", "direction", F.col("n") % 5 == 0)
    return out.select("o_custkey", "n", "side", "may_enter")
