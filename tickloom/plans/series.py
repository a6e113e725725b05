"""Queries over tick series: bars, book, windows, fills, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import views
from tickloom.operators import bars, joins, windows
from tickloom.operators.windows import bfill, ffill, ordered, running, trailing
from tickloom.plans.registry import query, rounded, table_query

W = "PARTITION BY exchange, symbol ORDER BY ts, seq"
OHLC = """round(CAST(first({p} ORDER BY ts, seq) AS DOUBLE), 6) AS open, round(CAST(max({p}) AS DOUBLE), 6) AS high,
round(CAST(min({p}) AS DOUBLE), 6) AS low, round(CAST(last({p} ORDER BY ts, seq) AS DOUBLE), 6) AS close"""


def r(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {name}"


def flow():
    """Signed size."""
    return F.col("side") * F.col("size")


def with_price(df):
    return df.withColumn("p", F.col("price").cast("double"))


# ---- bars -------------------------------------------------------------------------------------------------


@query("g01_time_bars", "ticks", f"""SELECT exchange, symbol, date_trunc('hour', ts) AS ts, {OHLC.format(p='price')},
{r('sum(size)', 'volume')}, count(*) AS n FROM ticks GROUP BY exchange, symbol, date_trunc('hour', ts)""")
def g01(t):
    return rounded(bars.time_bars(t, "1 hour"))


def _quote_sql(agg):
    side = lambda s: f"""{OHLC.format(p=s).replace(' AS open', f' AS {s}_open').replace(' AS high', f' AS {s}_high').replace(' AS low', f' AS {s}_low').replace(' AS close', f' AS {s}_close')},
CAST({agg.format(s=s)} AS BIGINT) AS {s}_size"""  # noqa: E731
    return f"SELECT exchange, symbol, date_trunc('hour', ts) AS ts, {side('bid')}, {side('ask')} FROM quotes GROUP BY exchange, symbol, date_trunc('hour', ts)"


@query("g02_quote_bars", "quotes", _quote_sql("max({s}_size)"))
def g02(q):
    return rounded(bars.quote_bars(q, "1 hour"))


@query("g03_last_filled", "ticks", f"""WITH b AS (SELECT exchange, symbol, date_trunc('hour', ts) AS ts, last(price ORDER BY ts, seq) AS price FROM ticks GROUP BY 1, 2, 3),
s AS (SELECT exchange, symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b GROUP BY exchange, symbol)
SELECT exchange, symbol, ts, {r('last_value(price IGNORE NULLS) OVER (PARTITION BY exchange, symbol ORDER BY ts)', 'price')} FROM s LEFT JOIN b USING (exchange, symbol, ts)""")
def g03(t):
    return rounded(bars.last_filled(t, "1 hour", "price"))


@query("g04_price_bars", "ticks", f"""WITH a AS (SELECT *, round_even(CAST(price AS DOUBLE) / 5, 0) * 5 AS p FROM ticks),
b AS (SELECT *, lag(p) OVER ({W}) AS q FROM a)
SELECT exchange, symbol, ts, last(p ORDER BY seq) AS price FROM b WHERE p <> q GROUP BY exchange, symbol, ts""")
def g04(t):
    return bars.price_bars(t, 5.0)


def _unit_sql(m, unit):
    return f"""WITH c AS (SELECT *, floor(sum(CAST({m} AS DECIMAL(38,10))) OVER ({W}) / {unit}) AS b FROM ticks),
d AS (SELECT exchange, symbol, ts, b - lag(b) OVER ({W}) AS n FROM c)
SELECT exchange, symbol, ts, CAST(sum(n) AS BIGINT) AS volume_size FROM d WHERE n <> 0 GROUP BY exchange, symbol, ts"""


@query("g05_volume_bars", "ticks", _unit_sql("side * size", 5))
def g05(t):
    return bars.unit_bars(t, flow(), 5)


@query("g05_volume_bars_buy", "ticks", _unit_sql("CASE WHEN side > 0 THEN size ELSE 0 END", 20))
def g05_buy(t):
    return bars.unit_bars(t, F.when(F.col("side") > 0, F.col("size")).otherwise(0), 20)


@query("g06_imbalance_bars", "ticks", _unit_sql("side * size * price", 1000))
def g06(t):
    return bars.unit_bars(t, flow() * F.col("price"), 1000)


@query("g08_dollar_bars", "ticks", f"""WITH c AS (SELECT *, CAST(floor(sum(CAST(price * size AS DECIMAL(38,10))) OVER ({W}) / 5000) AS BIGINT) AS volume_tick FROM ticks)
SELECT exchange, symbol, volume_tick, max(ts) AS ts, {OHLC.format(p='price')}, count(*) AS n, {r('sum(size)', 'volume')},
{r('sum(CASE WHEN side > 0 THEN size ELSE 0 END)', 'volume_buy')}, {r('sum(CASE WHEN side > 0 THEN 0 ELSE size END)', 'volume_sell')},
count(*) FILTER (side > 0) AS count_buy, count(*) FILTER (side <= 0) AS count_sell, {r('sum(price * size)', 'notional')}
FROM c GROUP BY exchange, symbol, volume_tick""")
def g08(t):
    return rounded(bars.dollar_bars(t, 5000))


@query("g10_counters", "ticks", f"""SELECT exchange, symbol, count(*) FILTER (m <> 0) AS count_non_zero, count(*) FILTER (m < 0) AS count_lt_zero,
count(*) FILTER (m > 0) AS count_gt_zero, {r('sum(CASE WHEN m > 0 THEN m ELSE 0 END)', 'sum_gt_zero')}, {r('sum(CASE WHEN m < 0 THEN m ELSE 0 END)', 'sum_lt_zero')}
FROM (SELECT *, side * size AS m FROM ticks) GROUP BY exchange, symbol""")
def g10(t):
    return rounded(bars.counters(t.withColumn("m", flow()), ["exchange", "symbol"], "m"))


@query("g11_size_delta", "quotes", f"""SELECT exchange, symbol, ts, seq, CAST(CASE WHEN bid = lag(bid) OVER ({W}) THEN bid_size - lag(bid_size) OVER ({W}) ELSE 0 END AS BIGINT) AS delta FROM quotes""")
def g11(q):
    return windows.near(q, lambda d, s: d.withColumn("delta", bars.size_delta("bid", "bid_size", s).cast("long")), 1).select("exchange", "symbol", "ts", "seq", "delta")


@query("g12_realised_volatility", "ticks", f"""WITH a AS (SELECT *, 1 + (CAST(price AS DOUBLE) - lag(CAST(price AS DOUBLE)) OVER ({W})) / CAST(price AS DOUBLE) AS x FROM ticks)
SELECT exchange, symbol, ts, seq, CASE WHEN count(x) OVER w = 20 THEN {r('stddev_samp(x) OVER w', 'v').replace(' AS v', '')} END AS volatility
FROM a WINDOW w AS ({W} ROWS 19 PRECEDING)""")
def g12(t):
    def volatility(d, s):
        d = d.withColumn("x", 1 + (F.col("p") - F.lag("p").over(ordered(s))) / F.col("p"))
        return d.withColumn("volatility", windows.full(F.col("x"), F.stddev_samp("x"), 20, trailing(20, s)))

    return rounded(windows.near(with_price(t), volatility, 20).select("exchange", "symbol", "ts", "seq", "volatility"))


@query("g13_imbalance_per_move", "ticks", f"""WITH a AS (SELECT *, side * size AS m, CAST(coalesce(lead(price) OVER ({W}) <> price, false) AS INT) AS f FROM ticks),
b AS (SELECT *, sum(f) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS run FROM a),
c AS (SELECT exchange, symbol, run, max(ts) AS ts, sum(m) AS m FROM b WHERE run > 0 GROUP BY exchange, symbol, run)
SELECT exchange, symbol, ts, CAST(trunc(avg(m)) AS INT) AS imbalance FROM c GROUP BY exchange, symbol, ts""")
def g13(t):
    return bars.imbalance_per_move(t, flow())


@query("g14_last_per_level", "l2", """SELECT exchange, symbol, ts, CAST(sign(size) AS INT) AS side, CAST(price AS DOUBLE) AS price,
CAST(last(size ORDER BY seq) AS BIGINT) AS size, CAST(last(count ORDER BY seq) AS BIGINT) AS count FROM l2 GROUP BY exchange, symbol, ts, sign(size), price""")
def g14(b):
    last = F.max_by(F.struct("size", "count"), "seq")
    out = b.groupBy("exchange", "symbol", "ts", F.signum("size").cast("int").alias("side"), F.col("price").cast("double").alias("price")).agg(last.alias("x"))
    return out.select("exchange", "symbol", "ts", "side", "price", F.col("x.size").cast("long").alias("size"), F.col("x.count").cast("long").alias("count"))


@query("g15_book_side_sums", "l2", f"""WITH a AS (SELECT exchange, symbol, date_trunc('hour', ts) AS ts, CAST(sign(size) AS INT) AS side, abs(round(CAST((price - 110) / 0.5 AS DOUBLE))) + 1 AS level, abs(size) AS size FROM l2)
SELECT exchange, symbol, ts, side, {r('sum(size * power(1 - 2.0 / 31, level - 1))', 'weighted')} FROM a GROUP BY exchange, symbol, ts, side""")
def g15(b):
    level = F.abs(F.round((F.col("price").cast("double") - 110) / 0.5)) + 1
    weight = F.abs("size") * F.pow(F.lit(1 - 2.0 / 31), level - 1)
    return rounded(b.groupBy("exchange", "symbol", F.date_trunc("hour", "ts").alias("ts"), F.signum("size").cast("int").alias("side")).agg(F.sum(weight).alias("weighted")))


@query("g16_spread_per_interval", "quotes", f"""SELECT exchange, symbol, date_trunc('minute', ts) AS ts, {r('last(ask - bid ORDER BY ts, seq)', 'spread_last')}, {r('max(ask - bid)', 'spread_max')} FROM quotes GROUP BY 1, 2, 3""")
def g16(q):
    x = q.withColumn("s", F.col("ask") - F.col("bid"))
    return rounded(x.groupBy("exchange", "symbol", F.date_trunc("minute", "ts").alias("ts")).agg(F.max_by("s", F.struct("ts", "seq")).alias("spread_last"), F.max("s").alias("spread_max")))


@query("g17_size_statistics", "ticks", f"""SELECT exchange, symbol, date_trunc('hour', ts) AS ts, {r('first(size ORDER BY ts, seq)', 'first')}, {r('max(size)', 'max')}, {r('min(size)', 'min')},
{r('last(size ORDER BY ts, seq)', 'last')}, {r('avg(size)', 'mean')}, count(*) AS n FROM ticks GROUP BY 1, 2, 3""")
def g17(t):
    at = F.struct("ts", "seq")
    return rounded(t.groupBy("exchange", "symbol", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.min_by("size", at).alias("first"), F.max("size").alias("max"), F.min("size").alias("min"),
        F.max_by("size", at).alias("last"), F.avg("size").alias("mean"), F.count(F.lit(1)).alias("n")))


@query("g27_density_rollup", "ticks", """SELECT exchange, symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) >= 500 AS dense FROM ticks GROUP BY ROLLUP (exchange, symbol, CAST(CAST(ts AS DATE) AS VARCHAR))""")
def g27(t):
    return t.rollup("exchange", "symbol", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("dense", F.col("n") >= 500)


# ---- order book -------------------------------------------------------------------------------------------


@query("b03_level_number", "l2", "SELECT exchange, symbol, ts, seq, CAST(abs(round(CAST((price - 110) / 0.5 AS DOUBLE))) + 1 AS INT) AS level FROM l2")
def b03(b):
    return b.select("exchange", "symbol", "ts", "seq", (F.abs(F.round((F.col("price").cast("double") - 110) / 0.5)) + 1).cast("int").alias("level"))


@query("b04_impute_count", "l2", "SELECT exchange, symbol, ts, seq, CAST(coalesce(nullif(count, 0), CASE WHEN abs(size) = 1 THEN 0 ELSE 1 END) AS INT) AS count FROM l2")
def b04(b):
    count = F.coalesce(F.nullif(F.col("count"), F.lit(0)), F.when(F.abs("size") == 1, 0).otherwise(1))
    return b.select("exchange", "symbol", "ts", "seq", count.cast("int").alias("count"))


@query("b05_level_distance", "l2", f"""SELECT exchange, symbol, {r('min(d)', 'step')} FROM (SELECT exchange, symbol, abs(price - lag(price) OVER ({W})) AS d FROM l2) WHERE d > 0 GROUP BY exchange, symbol""")
def b05(b):
    d = windows.near(b, lambda x, s: x.withColumn("d", F.abs(F.col("price") - F.lag("price").over(ordered(s)))), 1)
    return rounded(d.where("d > 0").groupBy("exchange", "symbol").agg(F.min("d").alias("step")))


@query("b09_size_added_removed", "quotes", f"""SELECT exchange, symbol, ts, seq, CAST(greatest(d, 0) AS BIGINT) AS added, CAST(greatest(-d, 0) AS BIGINT) AS removed
FROM (SELECT *, bid_size - lag(bid_size, 1, bid_size) OVER ({W}) AS d FROM quotes)""")
def b09(q):
    x = windows.near(q, lambda d, s: d.withColumn("d", F.col("bid_size") - F.coalesce(F.lag("bid_size").over(ordered(s)), F.col("bid_size"))), 1)
    return x.select("exchange", "symbol", "ts", "seq", F.greatest("d", F.lit(0)).cast("long").alias("added"), F.greatest(-F.col("d"), F.lit(0)).cast("long").alias("removed"))


_SIZES = (2, 6, 16)


@query("b10_rolling_quote_features", "quotes", "SELECT exchange, symbol, ts, seq, " + ", ".join(
    f"{r(f'(bid + ask) / 2 - lag((bid + ask) / 2, {n}) OVER ({W})', f'mid_delta_{n}')}, CAST(sum(bid_size) OVER ({W} ROWS {n - 1} PRECEDING) AS BIGINT) AS bid_sum_{n}" for n in _SIZES) + " FROM quotes")
def b10(q):
    x = q.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    names = [c for n in _SIZES for c in (f"mid_delta_{n}", f"bid_sum_{n}")]
    x = windows.near(x, lambda d, s: d.withColumns({f"mid_delta_{n}": F.col("mid") - F.lag("mid", n).over(ordered(s)) for n in _SIZES}), max(_SIZES))
    x = windows.with_rolling(x, {f"bid_sum_{n}": ("sum", "bid_size", n) for n in _SIZES})
    x = x.withColumns({f"bid_sum_{n}": F.round(f"bid_sum_{n}").cast("long") for n in _SIZES})
    return rounded(x.select("exchange", "symbol", "ts", "seq", *names))


@query("b11_rolling_deal_features", "ticks", "SELECT exchange, symbol, ts, seq, " + ", ".join(
    f"count(CASE WHEN side > 0 THEN 1 END) OVER ({W} ROWS {n - 1} PRECEDING) AS buys_{n}, CAST(sum(side) OVER ({W} ROWS {n - 1} PRECEDING) AS BIGINT) AS net_count_{n}, {r(f'sum(side * size) OVER ({W} ROWS {n - 1} PRECEDING)', f'net_size_{n}')}" for n in _SIZES) + " FROM ticks")
def b11(t):
    names = [c for n in _SIZES for c in (f"buys_{n}", f"net_count_{n}", f"net_size_{n}")]
    x = t.select("exchange", "symbol", "ts", "seq", F.when(F.col("side") > 0, 1).alias("buy"), "side", flow().cast("double").alias("flow"))
    of = {"buys": ("count", "buy"), "net_count": ("sum", "side"), "net_size": ("sum", "flow")}
    x = windows.with_rolling(x, {f"{name}_{n}": (*what, n) for n in _SIZES for name, what in of.items()})
    return rounded(x.select("exchange", "symbol", "ts", "seq", *[F.round(c).cast("long").alias(c) if "size" not in c else F.col(c) for c in names]))


@query("b12_named_rolling_metric", "ticks", f"""SELECT exchange, symbol, ts, seq, CASE WHEN count(*) OVER w = 10 THEN {r('sum(CASE WHEN side > 0 THEN size ELSE 0 END) OVER w', 'x')[:-5]} END AS deal_volume_buy_sum_10
FROM ticks WINDOW w AS ({W} ROWS 9 PRECEDING)""")
def b12(t):
    x = t.select("exchange", "symbol", "ts", "seq", F.when(F.col("side") > 0, F.col("size")).otherwise(0).cast("double").alias("v"))
    made = windows.with_rolling(x, {"deal_volume_buy_sum_10": ("sum", "v", 10)}, full_only=True)
    return rounded(made.select("exchange", "symbol", "ts", "seq", "deal_volume_buy_sum_10"))


# ---- windows ----------------------------------------------------------------------------------------------


@query("w01_cumulative_sum", "ticks", f"SELECT exchange, symbol, ts, seq, {r(f'sum(side * size) OVER ({W})', 'total')} FROM ticks")
def w01(t):
    return rounded(windows.cumsum_chunked(t, flow(), "total").select("exchange", "symbol", "ts", "seq", "total"))


_UP = (1, 4, 16)


@query("w02_upsample", "holes", f"SELECT exchange, symbol, ts, seq, " + ", ".join(
    f"CASE WHEN count(price) OVER ({W} ROWS {n - 1} PRECEDING) = {n} THEN round({a}(price) OVER ({W} ROWS {n - 1} PRECEDING), 6) END AS price_{a}_{n}" for n in _UP for a in ("sum", "avg", "max", "min")) + " FROM holes WHERE price IS NOT NULL")
def w02(h):
    up = windows.upsample(h, "price", list(_UP))
    return rounded(up.select("exchange", "symbol", "ts", "seq", *[f"price_{a}_{n}" for n in _UP for a in ("sum", "avg", "max", "min")]))


@query("w04_shift", "ticks", f"SELECT exchange, symbol, ts, seq, {r(f'lag(price, 5, CAST(0 AS DECIMAL(18,2))) OVER ({W})', 'back')}, {r(f'lead(price, 5, CAST(0 AS DECIMAL(18,2))) OVER ({W})', 'ahead')} FROM ticks")
def w04(t):
    x = windows.near(with_price(t), lambda d, s: d.withColumns({"back": F.lag("p", 5, 0.0).over(ordered(s)), "ahead": F.lead("p", 5, 0.0).over(ordered(s))}), 5, 5)
    return rounded(x.select("exchange", "symbol", "ts", "seq", "back", "ahead"))


@query("w05_zscore", "ticks", f"""SELECT exchange, symbol, ts, seq, CASE WHEN count(p) OVER w = 50 THEN round((p - avg(p) OVER w) / nullif(stddev_pop(p) OVER w, 0), 6) + 0.0 ELSE 0 END AS z
FROM (SELECT *, CAST(price AS DOUBLE) AS p FROM ticks) WINDOW w AS ({W} ROWS 49 PRECEDING)""")
def w05(t):
    x = windows.with_zscore(with_price(t), "p", 50)
    return rounded(x.select("exchange", "symbol", "ts", "seq", "z"))


@query("w07_slope", "ticks", f"""WITH a AS (SELECT *, (CAST(price AS DOUBLE) - lag(CAST(price AS DOUBLE), 5) OVER ({W})) / 5 AS s FROM ticks)
SELECT exchange, symbol, ts, seq, round(first_value(s IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS slope FROM a""")
def w07(t):
    x = windows.near(with_price(t), lambda d, s: d.withColumn("s", (F.col("p") - F.lag("p", 5).over(ordered(s))) / 5), 5)
    return rounded(windows.filled(x, {}, {"slope": "s"}).select("exchange", "symbol", "ts", "seq", "slope"))


@query("w08_differences", "ticks", f"""WITH a AS (SELECT *, CAST(price AS DOUBLE) - lag(CAST(price AS DOUBLE)) OVER ({W}) AS a FROM ticks)
SELECT exchange, symbol, ts, seq, round(a, 6) + 0.0 AS d1, round(a - lag(a) OVER ({W}), 6) + 0.0 AS d2 FROM a""")
def w08(t):
    def differences(d, s):
        d = d.withColumn("d1", F.col("p") - F.lag("p").over(ordered(s)))
        return d.withColumn("d2", F.col("d1") - F.lag("d1").over(ordered(s)))

    return rounded(windows.near(with_price(t), differences, 2).select("exchange", "symbol", "ts", "seq", "d1", "d2"))


@query("w09_top_and_bottom", "ticks", f"""SELECT exchange, symbol, ts, seq, CAST(p > mx - (mx - mn) * 0.1 AS INT) AS top, CAST(p < mn + (mx - mn) * 0.1 AS INT) AS bottom
FROM (SELECT *, CAST(price AS DOUBLE) AS p, max(CAST(price AS DOUBLE)) OVER w AS mx, min(CAST(price AS DOUBLE)) OVER w AS mn FROM ticks WINDOW w AS ({W} ROWS 29 PRECEDING))""")
def w09(t):
    x = windows.near(with_price(t), lambda d, s: d.withColumns({"mx": F.max("p").over(trailing(30, s)), "mn": F.min("p").over(trailing(30, s))}), 29)
    reach = (F.col("mx") - F.col("mn")) * 0.1
    return x.select("exchange", "symbol", "ts", "seq", (F.col("p") > F.col("mx") - reach).cast("int").alias("top"), (F.col("p") < F.col("mn") + reach).cast("int").alias("bottom"))


@query("w10_crossings", "ticks", f"""SELECT exchange, symbol, ts, seq, CASE WHEN q <= 200 AND p > 200 THEN 1 WHEN q >= 200 AND p < 200 THEN -1 ELSE 0 END AS crossed
FROM (SELECT *, CAST(price AS DOUBLE) AS p, lag(CAST(price AS DOUBLE)) OVER ({W}) AS q FROM ticks)""")
def w10(t):
    x = windows.near(with_price(t), lambda d, s: d.withColumn("q", F.lag("p").over(ordered(s))), 1)
    crossed = F.when((F.col("q") <= 200) & (F.col("p") > 200), 1).when((F.col("q") >= 200) & (F.col("p") < 200), -1).otherwise(0)
    return x.select("exchange", "symbol", "ts", "seq", crossed.alias("crossed"))


@query("w11_forward_extremes", "ticks", f"""SELECT exchange, symbol, ts, seq, round(mn / p - 1, 6) + 0.0 AS down, round(mx / p - 1, 6) + 0.0 AS up, CAST(mx / p - 1 > 0.5 AS INT) AS touched FROM (
SELECT *, CAST(price AS DOUBLE) AS p, CAST(min(price) OVER w AS DOUBLE) AS mn, CAST(max(price) OVER w AS DOUBLE) AS mx, count(*) OVER w AS n FROM ticks WINDOW w AS ({W} ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING)) WHERE n = 11""")
def w11(t):
    def extremes(d, s):
        w = windows.leading(11, s)
        return d.withColumns({"mn": F.min("p").over(w), "mx": F.max("p").over(w), "n": F.count(F.lit(1)).over(w)})

    x = windows.near(with_price(t), extremes, 0, 10).where("n = 11")
    up = F.col("mx") / F.col("p") - 1
    return rounded(x.select("exchange", "symbol", "ts", "seq", (F.col("mn") / F.col("p") - 1).alias("down"), up.alias("up"), (up > 0.5).cast("int").alias("touched")))


@query("w13_forward_difference", "ticks", f"SELECT exchange, symbol, ts, seq, round(q - p, 6) + 0.0 AS delta, round((q - p) / p, 6) + 0.0 AS share FROM (SELECT *, CAST(price AS DOUBLE) AS p, lead(CAST(price AS DOUBLE), 10) OVER ({W}) AS q FROM ticks)")
def w13(t):
    x = windows.near(with_price(t), lambda d, s: d.withColumn("q", F.lead("p", 10).over(ordered(s))), 0, 10)
    return rounded(x.select("exchange", "symbol", "ts", "seq", (F.col("q") - F.col("p")).alias("delta"), ((F.col("q") - F.col("p")) / F.col("p")).alias("share")))


@query("w14_running_max", "ticks", f"SELECT exchange, symbol, ts, seq, {r(f'max(price) OVER ({W})', 'top')}, {r(f'max(price) OVER ({W}) - price', 'drawdown')} FROM ticks")
def w14(t):
    x = windows.carried(t, {"top": ("max", F.col("price"))})
    return rounded(x.select("exchange", "symbol", "ts", "seq", "top", (F.col("top") - F.col("price")).alias("drawdown")))


@query("w15_tick_number", "ticks", "SELECT exchange, symbol, ts, seq, CAST(row_number() OVER (PARTITION BY exchange, symbol, date_trunc('hour', ts) ORDER BY seq) - 1 AS INT) AS tick_n FROM ticks")
def w15(t):
    w = windows.Window.partitionBy("exchange", "symbol", F.date_trunc("hour", "ts")).orderBy("seq")
    return t.select("exchange", "symbol", "ts", "seq", (F.row_number().over(w) - 1).alias("tick_n"))


@query("w16_last_per_ts", "ticks", f"SELECT exchange, symbol, date_trunc('hour', ts) AS ts, max(seq) AS seq, {r('last(price ORDER BY seq)', 'price')} FROM ticks GROUP BY 1, 2, 3")
def w16(t):
    return rounded(t.groupBy("exchange", "symbol", F.date_trunc("hour", "ts").alias("ts")).agg(F.max("seq").alias("seq"), F.max_by("price", "seq").alias("price")))


@query("w17_separated_entries", "ticks", f"""SELECT exchange, symbol, ts, seq, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER ({W})) > 1800000000, true) AS separate FROM ticks""")
def w17(t):
    gap = lambda s: F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(ordered(s)))
    x = windows.near(t, lambda d, s: d.withColumn("separate", F.coalesce(gap(s) > 1_800_000_000, F.lit(True))), 1)
    return x.select("exchange", "symbol", "ts", "seq", "separate")


@query("w18_downside_deviation", "ticks", f"""WITH a AS (SELECT *, CAST(price AS DOUBLE) - lag(CAST(price AS DOUBLE)) OVER ({W}) AS d FROM ticks)
SELECT exchange, symbol, round(stddev_pop(CASE WHEN d <= 0 THEN d ELSE 0 END), 6) AS downside FROM a WHERE d IS NOT NULL GROUP BY exchange, symbol""")
def w18(t):
    x = windows.near(with_price(t), lambda d, s: d.withColumn("d", F.col("p") - F.lag("p").over(ordered(s))), 1).where("d IS NOT NULL")
    return rounded(x.groupBy("exchange", "symbol").agg(F.stddev_pop(F.when(F.col("d") <= 0, F.col("d")).otherwise(0)).alias("downside")))


# ---- fills ------------------------------------------------------------------------------------------------


@query("f01_forward_fill", "holes", f"SELECT exchange, symbol, ts, seq, last_value(price IGNORE NULLS) OVER ({W}) AS price FROM holes")
def f01(h):
    return windows.filled(h, {"price": "price"}).select("exchange", "symbol", "ts", "seq", "price")


@query("f02_backward_fill", "holes", f"SELECT exchange, symbol, ts, seq, first_value(price IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price FROM holes")
def f02(h):
    return windows.filled(h, {}, {"price": "price"}).select("exchange", "symbol", "ts", "seq", "price")


@query("f03_fill_both_ways", "holes", f"SELECT exchange, symbol, ts, seq, coalesce(last_value(price IGNORE NULLS) OVER ({W}), first_value(price IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM holes")
def f03(h):
    return windows.filled(h, {"a": "price"}, {"z": "price"}).select("exchange", "symbol", "ts", "seq", F.coalesce("a", "z").alias("price"))


@query("f05_trim", "holes", """WITH a AS (SELECT exchange, symbol, min(ts) FILTER (price IS NOT NULL) AS a, max(ts) FILTER (price IS NOT NULL) AS z FROM holes GROUP BY exchange, symbol)
SELECT exchange, symbol, ts, seq, price FROM holes JOIN a USING (exchange, symbol) WHERE ts BETWEEN a AND z""")
def f05(h):
    return windows.started(h, ["price"]).select("exchange", "symbol", "ts", "seq", "price")


@query("f06_null_ranges", "holes", f"""WITH a AS (SELECT *, price IS NULL AS f, row_number() OVER ({W}) AS i FROM holes),
b AS (SELECT *, i - row_number() OVER (PARTITION BY exchange, symbol, f ORDER BY ts, seq) AS g FROM a)
SELECT exchange, symbol, min(ts) AS start, max(ts) AS "end", count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) <= 600000000 AS short FROM b WHERE f GROUP BY exchange, symbol, g""")
def f06(h):
    runs = windows.islands(h, F.col("price").isNull())
    return runs.withColumn("short", F.unix_micros("end") - F.unix_micros("start") <= 600_000_000)


@query("f07_interpolate", "holes", f"""WITH a AS (SELECT *, epoch_us(ts) AS t, CASE WHEN price IS NOT NULL THEN epoch_us(ts) END AS k FROM holes),
b AS (SELECT *, last_value(k IGNORE NULLS) OVER ({W}) AS t0, first_value(k IGNORE NULLS) OVER n AS t1, last_value(price IGNORE NULLS) OVER ({W}) AS x0, first_value(price IGNORE NULLS) OVER n AS x1
FROM a WINDOW n AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT exchange, symbol, ts, seq, round(coalesce(price, CASE WHEN t1 - t0 <= 7200000000 THEN x0 + (x1 - x0) * (t - t0) / nullif(t1 - t0, 0) END), 6) AS price FROM b""")
def f07(h):
    return rounded(windows.interpolate(h, "price", 7200).select("exchange", "symbol", "ts", "seq", "price"))


@query("f08_repeated_runs", "ticks", f"""WITH a AS (SELECT *, side = lag(side) OVER ({W}) AS f, row_number() OVER ({W}) AS i FROM ticks),
b AS (SELECT *, i - row_number() OVER (PARTITION BY exchange, symbol, f ORDER BY ts, seq) AS g FROM a)
SELECT exchange, symbol, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM b WHERE f GROUP BY exchange, symbol, g HAVING count(*) >= 5""")
def f08(t):
    x = windows.near(t, lambda d, s: d.withColumn("same", F.col("side") == F.lag("side").over(ordered(s))), 1)
    return windows.islands(x, F.col("same")).where("n >= 5")


@query("f09_volume_tick_gaps", "ticks", f"""WITH c AS (SELECT exchange, symbol, CAST(floor(sum(CAST(price * size AS DECIMAL(38,10))) OVER ({W}) / 500) AS BIGINT) AS k FROM ticks),
b AS (SELECT exchange, symbol, k, count(*) AS n FROM c GROUP BY exchange, symbol, k), s AS (SELECT exchange, symbol, unnest(generate_series(min(k), max(k))) AS k FROM b GROUP BY exchange, symbol)
SELECT exchange, symbol, k AS volume_tick, coalesce(n, 0) AS n, n IS NULL AS bfill FROM s LEFT JOIN b USING (exchange, symbol, k)""")
def f09(t):
    b = bars.dollar_bars(t, 500).select("exchange", "symbol", "volume_tick", "n")
    ends = b.groupBy("exchange", "symbol").agg(F.min("volume_tick").alias("a"), F.max("volume_tick").alias("z"))
    spine = ends.select("exchange", "symbol", F.explode(F.sequence("a", "z")).alias("volume_tick"))
    out = spine.join(b, ["exchange", "symbol", "volume_tick"], "left")
    return out.select("exchange", "symbol", "volume_tick", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("bfill"))


# ---- joins ------------------------------------------------------------------------------------------------


_HOUR = "SELECT exchange, symbol, date_trunc('hour', ts) AS ts, sum(size) AS v FROM ticks GROUP BY 1, 2, 3"


@query("j01_outer_on_ts", "ticks", f"WITH h AS ({_HOUR}) SELECT ts, " + ", ".join(f"{r(f'''sum(v) FILTER (symbol = 'S{i}')''', f'S{i}')}" for i in range(5)) + " FROM h GROUP BY ts")
def j01(t):
    h = t.groupBy("exchange", "symbol", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("size").alias("v"))
    return rounded(h.groupBy("ts").pivot("symbol", [f"S{i}" for i in range(5)]).agg(F.sum("v")))


@query("j02_common_ts", "ticks", f"WITH h AS ({_HOUR}) SELECT ts FROM h GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM h)")
def j02(t):
    return joins.common_ts(t.select("exchange", "symbol", F.date_trunc("hour", "ts").alias("ts")), "symbol")


@table_query("j03_asof", f"SELECT t.exchange, t.symbol, t.ts, t.seq, {r('q.bid', 'bid')}, {r('q.ask', 'ask')} FROM ticks t ASOF LEFT JOIN quotes q ON t.exchange = q.exchange AND t.symbol = q.symbol AND t.ts >= q.ts")
def j03(spark, sf_dir):
    t, q = (views.frame(spark, sf_dir, v) for v in (views.TICKS, views.QUOTES))
    return rounded(joins.asof(t.select("exchange", "symbol", "ts", "seq"), q, ["exchange", "symbol"], ["bid", "ask"]))


@table_query("j07_interval_bin", f"""WITH c AS (SELECT exchange, symbol, ts, CAST(floor(sum(CAST(price * size AS DECIMAL(38,10))) OVER ({W}) / 5000) AS BIGINT) AS k FROM ticks),
e AS (SELECT exchange, symbol, k AS volume_tick, max(ts) AS ts FROM c GROUP BY exchange, symbol, k)
SELECT q.exchange, q.symbol, q.ts, q.seq, e.volume_tick FROM quotes q ASOF JOIN e ON q.exchange = e.exchange AND q.symbol = e.symbol AND q.ts <= e.ts""")
def j07(spark, sf_dir):
    t, q = (views.frame(spark, sf_dir, v) for v in (views.TICKS, views.QUOTES))
    ends = bars.dollar_bars(t, 5000).select("exchange", "symbol", "ts", "volume_tick")
    return joins.interval_bin(q.select("exchange", "symbol", "ts", "seq"), ends, ["exchange", "symbol"], "volume_tick")


@table_query("j08_pad_quotes", f"SELECT exchange, symbol, ts, {r('bid', 'bid')} FROM quotes UNION ALL SELECT DISTINCT exchange, symbol, ts, CAST(NULL AS DOUBLE) FROM ticks t WHERE NOT EXISTS (SELECT 1 FROM quotes q WHERE q.exchange = t.exchange AND q.symbol = t.symbol AND q.ts = t.ts)")
def j08(spark, sf_dir):
    t, q = (views.frame(spark, sf_dir, v) for v in (views.TICKS, views.QUOTES))
    return rounded(joins.pad_missing(q.select("exchange", "symbol", "ts", "bid"), t, ["exchange", "symbol"]))


@query("j10_first_touch", "ticks", """WITH e AS (SELECT seq AS id, exchange, symbol, ts, ts + INTERVAL 2 HOUR AS "end", price AS p0, side FROM ticks),
h AS (SELECT id, c.ts, c.seq, row_number() OVER (PARTITION BY id ORDER BY c.ts, c.seq) AS i FROM e JOIN ticks c ON c.exchange = e.exchange AND c.symbol = e.symbol AND c.ts > e.ts AND c.ts <= e."end" AND (c.price - p0) * e.side >= 20)
SELECT e.id, e.exchange, e.symbol, e.ts, h.ts AS touch_ts, h.seq AS touch_seq FROM e LEFT JOIN h ON h.id = e.id AND i = 1""")
def j10(t):
    end, level = F.col("ts") + F.expr("INTERVAL 2 HOUR"), F.col("price") + 20 * F.col("side")
    e = t.select(F.col("seq").alias("id"), "exchange", "symbol", "ts", end.alias("end"), level.cast("double").alias("level"), (F.col("side") > 0).alias("up"))
    curve = t.select("exchange", "symbol", "ts", "seq", F.col("price").cast("double").alias("price"))
    return joins.first_touch(e, curve, ["exchange", "symbol"], "price").select("id", "exchange", "symbol", "ts", "touch_ts", "touch_seq")


@query("j12_score_distinct", "ticks", f"SELECT exchange, symbol, ts, seq, {r('size * 2 + side', 'score')} FROM ticks")
def j12(t):
    return rounded(joins.score_distinct(t, ["size", "side"], F.col("size") * 2 + F.col("side")).select("exchange", "symbol", "ts", "seq", "score"))


@table_query("j14_supplier_parts", """SELECT p_brand AS color, CAST(sum(l_quantity) AS DOUBLE) AS qty, count(DISTINCT s_nationkey) AS cities
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_brand""")
def j14(spark, sf_dir):
    li, p, s = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("lineitem", "part", "supplier"))
    out = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    return out.groupBy(F.col("p_brand").alias("color")).agg(F.sum("l_quantity").cast("double").alias("qty"), F.count_distinct("s_nationkey").alias("cities"))
