"""Queries over features: scalars, indicators, labels, evaluation, trades, store, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom import views
from tickloom.functions import indicators as ta
from tickloom.operators import labels, store, trades, windows
from tickloom.operators.windows import ordered
from tickloom.plans.registry import query, rounded, table_query

W = "PARTITION BY exchange, symbol ORDER BY ts, seq"
D = "ORDER BY day"


def day_series(d):
    """The daily table as a series."""
    out = d.select(F.lit("").alias("exchange"), F.lit("orders").alias("symbol"), F.col("day").cast("timestamp").alias("ts"), F.lit(0).alias("seq"), "day", "volume",
                   *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")])
    return out


DAYS = "a AS (SELECT day, CAST(open AS DOUBLE) AS o, CAST(high AS DOUBLE) AS h, CAST(low AS DOUBLE) AS l, CAST(close AS DOUBLE) AS c, volume AS v FROM daily)"


def ready(n: int, x: str) -> str:
    return f"CASE WHEN count(*) OVER ({D} ROWS {n - 1} PRECEDING) = {n} THEN round({x}, 6) + 0.0 END"


def win(n: int) -> str:
    return f"OVER ({D} ROWS {n - 1} PRECEDING)"


def indicator(name: str, sql: str, **cols):
    """Register columns over the daily series; `sql` selects the same from `a`."""

    @query(name, "daily", f"WITH {DAYS} {sql}")
    def run(d):
        made = {k: v() for k, v in cols.items()}
        return rounded(day_series(d).withColumns(made).select(F.col("day").cast("string").alias("day"), *made))

    return run


DAY = "CAST(day AS VARCHAR) AS day"
indicator("t01_momentum", f"SELECT {DAY}, round(c - lag(c, 10) OVER ({D}), 6) + 0.0 AS mom, round(100 * (c / lag(c, 10) OVER ({D}) - 1), 6) + 0.0 AS roc FROM a",
          mom=lambda: ta.mom("close", 10), roc=lambda: ta.roc("close", 10))
indicator("t02_averages", f"SELECT {DAY}, {ready(20, f'avg(c) {win(20)}')} AS sma, {ready(20, f'(max(c) {win(20)} + min(c) {win(20)}) / 2')} AS midpoint, "
          f"{ready(5, f'(5 * c + 4 * lag(c, 1) OVER ({D}) + 3 * lag(c, 2) OVER ({D}) + 2 * lag(c, 3) OVER ({D}) + lag(c, 4) OVER ({D})) / 15')} AS wma FROM a",
          sma=lambda: ta.sma("close", 20), midpoint=lambda: ta.midpoint("close", 20), wma=lambda: ta.wma("close", 5))
indicator("t03_extremes", f"SELECT {DAY}, {ready(30, f'max(c) {win(30)}')} AS mx, {ready(30, f'min(c) {win(30)}')} AS mn, {ready(30, f'sum(c) {win(30)}')} AS total FROM a",
          mx=lambda: windows.full(F.col("close"), F.max("close"), 30, windows.trailing(30)), mn=lambda: windows.full(F.col("close"), F.min("close"), 30, windows.trailing(30)),
          total=lambda: windows.full(F.col("close"), F.sum("close"), 30, windows.trailing(30)))
indicator("t04_bands", f"SELECT {DAY}, {ready(20, f'avg(c) {win(20)} + 2 * stddev_pop(c) {win(20)}')} AS upper, {ready(20, f'avg(c) {win(20)} - 2 * stddev_pop(c) {win(20)}')} AS lower FROM a",
          upper=lambda: ta.bbands("close", 20, 2)[0], lower=lambda: ta.bbands("close", 20, 2)[2])
indicator("t04_deviations", f"SELECT {DAY}, {ready(5, f'2 * stddev_pop(c) {win(5)}')} AS stddev, {ready(5, f'var_pop(c) {win(5)} / 1e6')} AS var FROM a",
          stddev=lambda: ta.stddev("close", 5, 2.0), var=lambda: ta.variance("close", 5) / 1e6)
indicator("t05_aroon", f"""SELECT {DAY}, CASE WHEN n = 15 THEN round(100.0 * (14 - (i - list_max(list_transform(list_filter(range(1, 16), lambda k: hs[k] = list_max(hs)), lambda k: k + i - 15)))) / 14, 6) + 0.0 END AS up,
CASE WHEN n = 15 THEN round(100.0 * (14 - (i - list_max(list_transform(list_filter(range(1, 16), lambda k: ls[k] = list_min(ls)), lambda k: k + i - 15)))) / 14, 6) + 0.0 END AS down
FROM (SELECT day, row_number() OVER ({D}) AS i, list(h) {win(15)} AS hs, list(l) {win(15)} AS ls, count(*) {win(15)} AS n FROM a)""",
          up=lambda: ta.aroon("high", "low", 14)[0], down=lambda: ta.aroon("high", "low", 14)[1])
indicator("t06_balance_of_power", f"SELECT {DAY}, CASE WHEN h <> l THEN round((c - o) / (h - l), 6) + 0.0 ELSE 0.0 END AS bop FROM a", bop=lambda: ta.bop("open", "high", "low", "close"))
indicator("t07_cci", f"""SELECT {DAY}, CASE WHEN n = 14 THEN round(CASE WHEN dev <> 0 THEN (t - m) / (0.015 * dev) ELSE 0 END, 6) + 0.0 END AS cci FROM (
SELECT *, list_sum(list_transform(ts, lambda x: abs(x - m))) / 14 AS dev FROM (SELECT day, (h + l + c) / 3 AS t, list((h + l + c) / 3) {win(14)} AS ts, avg((h + l + c) / 3) {win(14)} AS m, count(*) {win(14)} AS n FROM a))""",
          cci=lambda: ta.cci("high", "low", "close", 14))
_RANGE = f"max(h) {win(14)} - min(l) {win(14)}"
indicator("t08_stochastics", f"SELECT {DAY}, {ready(14, f'-100 * (max(h) {win(14)} - c) / nullif({_RANGE}, 0)')} AS willr, {ready(14, f'100 - 100 * (max(h) {win(14)} - c) / nullif({_RANGE}, 0)')} AS k FROM a",
          willr=lambda: ta.willr("high", "low", "close", 14), k=lambda: ta.stoch_k("high", "low", "close", 14))
indicator("t10_price_oscillators", f"SELECT {DAY}, CASE WHEN count(*) {win(26)} = 26 THEN round(avg(c) {win(12)} - avg(c) {win(26)}, 6) + 0.0 END AS apo, CASE WHEN count(*) {win(26)} = 26 THEN round(100 * (avg(c) {win(12)} - avg(c) {win(26)}) / avg(c) {win(26)}, 6) + 0.0 END AS ppo FROM a",
          apo=lambda: ta.apo("close", 12, 26), ppo=lambda: ta.ppo("close", 12, 26))
indicator("t12_true_range", f"SELECT {DAY}, round(greatest(h - l, abs(h - lag(c) OVER ({D})), abs(l - lag(c) OVER ({D}))), 6) + 0.0 AS tr FROM a", tr=lambda: ta.true_range("high", "low", "close"))
indicator("t18_average_prices", f"SELECT {DAY}, round((o + h + l + c) / 4, 6) AS avgprice, round((h + l + 2 * c) / 4, 6) AS wclprice FROM a",
          avgprice=lambda: (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4, wclprice=lambda: (F.col("high") + F.col("low") + 2 * F.col("close")) / 4)


indicator("t01_ratios", f"SELECT {DAY}, round(c / lag(c, 10) OVER ({D}) - 1, 6) + 0.0 AS rocp, round(100 * c / lag(c, 10) OVER ({D}), 6) + 0.0 AS rocr100 FROM a",
          rocp=lambda: F.col("close") / F.lag("close", 10).over(ordered()) - 1, rocr100=lambda: 100 * F.col("close") / F.lag("close", 10).over(ordered()))
indicator("t02_triangular_and_midprice", f"SELECT {DAY}, {ready(20, f'avg(s) {win(10)}')} AS trima, {ready(14, f'(max(h) {win(14)} + min(l) {win(14)}) / 2')} AS midprice FROM (SELECT *, avg(c) {win(11)} AS s FROM a)",
          trima=lambda: ta.trima("close", 20), midprice=lambda: ta.midprice("high", "low", 14))
indicator("t05_aroon_oscillator", f"""SELECT {DAY}, CASE WHEN n = 15 THEN round(100.0 * (list_max(list_filter(range(1, 16), lambda k: hs[k] = list_max(hs))) - list_max(list_filter(range(1, 16), lambda k: ls[k] = list_min(ls)))) / 14, 6) + 0.0 END AS aroonosc
FROM (SELECT day, list(h) {win(15)} AS hs, list(l) {win(15)} AS ls, count(*) {win(15)} AS n FROM a)""",
          aroonosc=lambda: ta.aroon("high", "low", 14)[0] - ta.aroon("high", "low", 14)[1])


@query("t03_extreme_indexes", "daily", f"""WITH {DAYS}, b AS (SELECT day, row_number() OVER ({D}) - 1 AS i, list(c) {win(30)} AS cs FROM a)
SELECT {DAY}, CASE WHEN len(cs) = 30 THEN i - 30 + list_max(list_filter(range(1, 31), lambda k: cs[k] = list_max(cs))) END AS maxindex, CASE WHEN len(cs) = 30 THEN i - 30 + list_max(list_filter(range(1, 31), lambda k: cs[k] = list_min(cs))) END AS minindex FROM b""")
def t03_indexes(d):
    x = day_series(d).withColumn("i", (F.row_number().over(ordered()) - 1).cast("long"))
    top, low = ta.extreme_rows("close", "i", 30)
    return x.select(F.col("day").cast("string").alias("day"), top.alias("maxindex"), low.alias("minindex"))


@query("t08_smoothed_stochastics", "daily", f"""WITH {DAYS}, k AS (SELECT day, CASE WHEN count(*) {win(5)} = 5 THEN coalesce(100 * (c - min(l) {win(5)}) / nullif(max(h) {win(5)} - min(l) {win(5)}, 0), 0) END AS k FROM a),
s AS (SELECT day, k, CASE WHEN count(k) {win(3)} = 3 THEN avg(k) {win(3)} END AS s FROM k)
SELECT {DAY}, round(k, 6) + 0.0 AS fast_k, round(s, 6) + 0.0 AS fast_d, round(s, 6) + 0.0 AS slow_k, CASE WHEN count(s) {win(3)} = 3 THEN round(avg(s) {win(3)}, 6) + 0.0 END AS slow_d FROM s""")
def t08_smoothed(d):
    x = ta.with_stochastics(day_series(d), "high", "low", "close", 5, 3)
    return rounded(x.select(F.col("day").cast("string").alias("day"), "fast_k", "fast_d", "slow_k", "slow_d"))


@query("t17_angle_and_beta", "daily", f"""WITH {DAYS}, b AS (SELECT *, row_number() OVER ({D}) AS i, h / lag(h) OVER ({D}) - 1 AS x, l / lag(l) OVER ({D}) - 1 AS y FROM a)
SELECT {DAY}, {ready(14, f'degrees(atan(regr_slope(c, i) {win(14)}))')} AS angle, CASE WHEN count(x) {win(5)} = 5 THEN round(covar_pop(x, y) {win(5)} / nullif(var_pop(x) {win(5)}, 0), 6) + 0.0 END AS beta FROM b""")
def t17_more(d):
    gain = lambda c: F.col(c) / F.lag(c).over(ordered()) - 1
    x = day_series(d).withColumns({"i": F.row_number().over(ordered()), "x": gain("high"), "y": gain("low")})
    beta = windows.full(F.col("x"), F.regr_slope("y", "x"), 5, windows.trailing(5))
    return rounded(x.select(F.col("day").cast("string").alias("day"), F.degrees(F.atan(ta.regression("close", "i", 14)[0])).alias("angle"), beta.alias("beta")))


@query("t13_volume_flow", "daily", f"""WITH {DAYS}, s AS (SELECT day, CASE WHEN h <> l THEN ((c - l) - (h - c)) / (h - l) * v ELSE 0 END AS ad, coalesce(sign(c - lag(c) OVER ({D})) * v, v) AS ob FROM a)
SELECT {DAY}, round(sum(ad) OVER ({D}), 6) + 0.0 AS ad, round(sum(ob) OVER ({D}), 6) + 0.0 AS obv FROM s""")
def t13(d):
    x = day_series(d).withColumn("s", ta.ad_step("high", "low", "close", "volume")).withColumn("b", ta.obv("close", "volume"))
    return rounded(x.select(F.col("day").cast("string").alias("day"), ta.cumulative("s").alias("ad"), ta.cumulative("b").alias("obv")))


# ---- scalars ----------------------------------------------------------------------------------------------


@query("p01_measurable", "ticks", """SELECT exchange, symbol, ts, seq, side AS tick, round(CAST(side * size AS DOUBLE), 6) AS sym, round(CAST(side * size * price AS DOUBLE), 6) AS usd FROM ticks""")
def p01(t):
    flow = F.col("side") * F.col("size")
    return rounded(t.select("exchange", "symbol", "ts", "seq", F.col("side").alias("tick"), flow.alias("sym"), (flow * F.col("price")).alias("usd")))


@query("p02_split_sides", "ticks", "SELECT exchange, symbol, ts, seq, CAST(CASE WHEN side > 0 THEN size ELSE 0 END AS DOUBLE) AS buy, CAST(CASE WHEN side > 0 THEN 0 ELSE size END AS DOUBLE) AS sell, CAST(side > 0 AS INT) AS is_buy FROM ticks")
def p02(t):
    buy = F.col("side") > 0
    return rounded(t.select("exchange", "symbol", "ts", "seq", F.when(buy, F.col("size")).otherwise(0).alias("buy"), F.when(buy, 0).otherwise(F.col("size")).alias("sell"), buy.cast("int").alias("is_buy")))


@query("p04_spread_and_mid", "quotes", "SELECT exchange, symbol, ts, seq, round_even(CAST((ask - bid) / 0.05 AS DOUBLE), 0) AS ticks_wide, round(CAST((bid + ask) / 2 AS DOUBLE), 6) AS mid FROM quotes")
def p04(q):
    return rounded(q.select("exchange", "symbol", "ts", "seq", F.bround(((F.col("ask") - F.col("bid")) / 0.05).cast("double")).alias("ticks_wide"), ((F.col("bid") + F.col("ask")) / 2).alias("mid")))


@query("p07_min_max_scale", "ticks", "SELECT exchange, symbol, ts, seq, round((p - mn) / nullif(mx - mn, 0), 6) AS x, CAST(trunc((p - mn) / nullif(mx - mn, 0) * 1000) AS BIGINT) AS code FROM (SELECT *, CAST(price AS DOUBLE) AS p FROM ticks), (SELECT CAST(min(price) AS DOUBLE) AS mn, CAST(max(price) AS DOUBLE) AS mx FROM ticks)")
def p07(t):
    b = t.agg(F.min("price").cast("double").alias("mn"), F.max("price").cast("double").alias("mx"))
    x = (F.col("price").cast("double") - F.col("mn")) / F.nullif(F.col("mx") - F.col("mn"), F.lit(0.0))
    return rounded(t.join(F.broadcast(b)).select("exchange", "symbol", "ts", "seq", x.alias("x"), (x * 1000).cast("long").alias("code")))


@query("p09_equal_width_bins", "ticks", """WITH b AS (SELECT CAST(min(price) AS DOUBLE) AS mn, CAST(max(price) AS DOUBLE) AS mx FROM ticks)
SELECT exchange, symbol, ts, seq, len(list_filter(range(0, 21), lambda i: mn + i * ((mx - mn) / 20.1) < CAST(price AS DOUBLE))) AS code FROM ticks, b""")
def p09(t):
    b = t.agg(F.min("price").cast("double").alias("mn"), F.max("price").cast("double").alias("mx"))
    edges = b.select(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.col("mn") + i * ((F.col("mx") - F.col("mn")) / 20.1)).alias("edges"))
    code = F.size(F.filter("edges", lambda e: e < F.col("price").cast("double")))
    return t.join(F.broadcast(edges)).select("exchange", "symbol", "ts", "seq", code.cast("long").alias("code"))


@query("p13_pair_features", "daily", f"WITH {DAYS} SELECT {DAY}, round(o - c, 6) + 0.0 AS open_close, round(h - l, 6) AS high_low, CASE WHEN o > c THEN 1 WHEN o < c THEN -1 ELSE 0 END AS open_gt_close FROM a")
def p13(d):
    x = day_series(d)
    sign = F.when(F.col("open") > F.col("close"), 1).when(F.col("open") < F.col("close"), -1).otherwise(0)
    return rounded(x.select(F.col("day").cast("string").alias("day"), (F.col("open") - F.col("close")).alias("open_close"), (F.col("high") - F.col("low")).alias("high_low"), sign.alias("open_gt_close")))


@query("p14_round_to_multiple", "ticks", "SELECT exchange, symbol, ts, seq, floor(CAST(price AS DOUBLE) / 0.25 + 0.5) * 0.25 AS x FROM ticks")
def p14(t):
    return rounded(t.select("exchange", "symbol", "ts", "seq", (F.floor(F.col("price").cast("double") / 0.25 + 0.5) * 0.25).alias("x")))


@query("p19_three_classes", "ticks", f"""SELECT exchange, symbol, ts, seq, CASE WHEN x < -0.1 THEN 0 WHEN x > 0.1 THEN 2 ELSE 1 END AS label FROM (SELECT *, CAST(lead(price) OVER ({W}) AS DOUBLE) / CAST(price AS DOUBLE) - 1 AS x FROM ticks) WHERE x IS NOT NULL""")
def p19(t):
    x = windows.near(t, lambda d, s: d.withColumn("x", F.lead("price").over(ordered(s)).cast("double") / F.col("price").cast("double") - 1), 0, 1).where("x IS NOT NULL")
    return x.select("exchange", "symbol", "ts", "seq", F.when(F.col("x") < -0.1, 0).when(F.col("x") > 0.1, 2).otherwise(1).alias("label"))


@query("p22_weekday_elapsed", "ticks", f"SELECT exchange, symbol, ts, seq, CAST(isodow(ts) - 1 AS INT) AS weekday, epoch_us(ts) - epoch_us(first_value(ts) OVER ({W})) AS elapsed_us FROM ticks")
def p22(t):
    begin = t.groupBy("exchange", "symbol").agg(F.min("ts").alias("begin"))
    x = t.join(begin, ["exchange", "symbol"])
    return x.select("exchange", "symbol", "ts", "seq", F.weekday("ts").alias("weekday"), (F.unix_micros("ts") - F.unix_micros("begin")).alias("elapsed_us"))


# ---- labels, splits, evaluation ---------------------------------------------------------------------------


@query("l01_triple_barrier", "ticks", f"""WITH a AS (SELECT exchange, symbol, ts, seq, CAST(price AS DOUBLE) AS p0, list(CAST(price AS DOUBLE)) OVER ({W} ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS ps FROM ticks),
f AS (SELECT exchange, symbol, ts, seq, coalesce(list_position(list_transform(ps[2:11], lambda x: x / p0 >= 1 + 0.2 * 1.5), true), 11) AS lt, coalesce(list_position(list_transform(ps[2:11], lambda x: x / p0 <= 1 - 0.2 * 1.0), true), 11) AS ls,
coalesce(list_position(list_transform(ps[2:11], lambda x: x / p0 <= 1 - 0.2 * 1.5), true), 11) AS st, coalesce(list_position(list_transform(ps[2:11], lambda x: x / p0 >= 1 + 0.2 * 1.0), true), 11) AS ss FROM a WHERE len(ps) = 11)
SELECT exchange, symbol, ts, seq, CASE WHEN st < ss AND st < lt THEN -1 WHEN lt < ls AND lt < st THEN 1 ELSE 0 END AS label FROM f""".replace("coalesce(list_position", "coalesce(nullif(list_position").replace(", true), 11)", ", true), 0), 11)"))
def l01(t):
    x = t.select("exchange", "symbol", "ts", "seq", F.col("price").cast("double").alias("p"), F.lit(0.2).alias("v"))
    return labels.triple_barrier(x, "p", "v", 10, 1.5, 1.0).select("exchange", "symbol", "ts", "seq", "label")


@query("l02_label_changes", "ticks", f"SELECT exchange, symbol, ts, seq, side FROM (SELECT *, coalesce(lag(side) OVER ({W}), 0) AS b FROM ticks) WHERE side <> b")
def l02(t):
    return labels.changes(t, "side").select("exchange", "symbol", "ts", "seq", "side")


@query("l03_decayed_return", "ticks", f"""WITH a AS (SELECT *, (CAST(price AS DOUBLE) - lag(CAST(price AS DOUBLE)) OVER ({W})) / CAST(price AS DOUBLE) / 100 AS ret FROM ticks)
SELECT exchange, symbol, ts, seq, CASE WHEN len(rs) = 4 THEN round((1 + rs[1]) * (1 + rs[2] * power(1 - 2 / 5.0, 1)) * (1 + rs[3] * power(1 - 2 / 5.0, 2)) * (1 + rs[4] * power(1 - 2 / 5.0, 3)), 6) END AS forward
FROM (SELECT *, list(ret) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS rs FROM a)""")
def l03(t):
    p = F.col("price").cast("double")

    def forward(d, s):
        d = d.withColumn("ret", (p - F.lag(p).over(ordered(s))) / p / 100)
        return d.withColumn("forward", labels.decayed_return("ret", 4, s))

    return rounded(windows.near(t, forward, 1, 4).select("exchange", "symbol", "ts", "seq", "forward"))


@query("l05_event_sample", "ticks", """WITH s AS (SELECT exchange, symbol, stddev_samp(CAST(price AS DOUBLE) - 100) AS sd FROM ticks GROUP BY exchange, symbol),
h AS (SELECT t.exchange, t.symbol, ts, seq FROM ticks t JOIN s USING (exchange, symbol) WHERE abs(CAST(price AS DOUBLE) - 100) >= 2 * sd)
SELECT * FROM h WHERE (exchange, symbol) IN (SELECT (exchange, symbol) FROM h GROUP BY exchange, symbol HAVING count(*) <= 100000)""")
def l05(t):
    return labels.event_sample(t.withColumn("x", F.col("price").cast("double") - 100), "x", 2.0, 100_000).select("exchange", "symbol", "ts", "seq")


@query("l08_class_weights", "ticks", "SELECT exchange, symbol, ts, seq, round(CASE WHEN c = 0 THEN 0.5 ELSE 0.25 END / count(*) OVER (PARTITION BY c), 9) AS weight FROM (SELECT *, seq % 3 - 1 AS c FROM ticks)")
def l08(t):
    x = labels.class_weights(t.withColumn("c", F.col("seq") % 3 - 1), "c")
    return x.select("exchange", "symbol", "ts", "seq", F.round("weight", 9).alias("weight"))


@query("l10_holdout", "ticks", f"SELECT exchange, symbol, ts, seq, i >= n - CAST(floor(n * 0.3) AS BIGINT) AS held_out FROM (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY exchange, symbol) AS n FROM ticks)")
def l10(t):
    return labels.holdout(t).select("exchange", "symbol", "ts", "seq", "held_out")


@query("l11_purged_folds", "ticks", f"""WITH x AS (SELECT exchange, symbol, row_number() OVER ({W}) - 1 AS ix, count(*) OVER (PARTITION BY exchange, symbol) AS n FROM ticks),
f AS (SELECT *, fold * (n // 5) + least(fold, n % 5) AS b FROM x, (SELECT unnest(range(0, 5)) AS fold)),
g AS (SELECT *, b + n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS e, CASE WHEN fold > 0 AND fold < 4 THEN 251 ELSE 250 END AS before FROM f)
SELECT exchange, symbol, ix, CAST(fold AS INT) AS fold, CASE WHEN ix >= b AND ix < e THEN 'test' WHEN ix < b AND ix >= b - before THEN 'purged' WHEN ix >= e AND ix < e + 250 THEN 'purged' ELSE 'train' END AS role FROM g""")
def l11(t):
    return labels.purged_folds(t, 5, 250)


PRED = "SELECT event_id, value / 500 AS p, event_type = 'purchase' AS y FROM events"


@table_query("l16_confusion", f"""SELECT count(*) FILTER (y AND p >= 0.5) AS tp, count(*) FILTER (NOT y AND p >= 0.5) AS fp, count(*) FILTER (y AND p < 0.5) AS fn, count(*) FILTER (NOT y AND p < 0.5) AS tn,
round(avg(-ln(greatest(1e-15, CASE WHEN y THEN p ELSE 1 - p END))), 6) AS logloss FROM ({PRED})""")
def l16(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("value") / 500).alias("p"), (F.col("event_type") == "purchase").alias("y"))
    y, hit = F.col("y"), F.col("p") >= 0.5
    loss = F.avg(-F.log(F.greatest(F.lit(1e-15), F.when(y, F.col("p")).otherwise(1 - F.col("p")))))
    return rounded(e.agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"), loss.alias("logloss")))


@table_query("l19_quantile_errors", f"""SELECT q, round(avg(abs(CAST(y AS INT) - p)), 6) AS mae, round(avg(power(CAST(y AS INT) - p, 2)), 6) AS mse, round(avg(greatest(q * (CAST(y AS INT) - p), (q - 1) * (CAST(y AS INT) - p))), 6) AS pinball
FROM ({PRED}), (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q) GROUP BY q""")
def l19(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("value") / 500).alias("p"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    x = e.withColumn("q", F.explode(F.array(*[F.lit(q) for q in (0.1, 0.5, 0.9)])))
    d = F.col("y") - F.col("p")
    return rounded(x.groupBy("q").agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.avg(F.greatest(F.col("q") * d, (F.col("q") - 1) * d)).alias("pinball")))


@table_query("l20_error_by_decile", f"SELECT CAST(least(9, floor(p * 10)) AS INT) AS decile, count(*) AS n, round(avg(abs(CAST(y AS INT) - p)), 6) AS mae FROM ({PRED}) GROUP BY 1")
def l20(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("value") / 500).alias("p"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return rounded(e.groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("int").alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae")))


# ---- trades -----------------------------------------------------------------------------------------------


def ledger(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_totalprice").cast("decimal(18,2)")).alias("price"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    n = F.row_number().over(w)
    return o.withColumn("n", n).withColumn("direction", F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)).withColumn("timing", F.when(F.col("n") % 2 == 1, "entry").otherwise("exit"))


LEDGER = "g AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS direction FROM orders)"
TRIPS = LEDGER + """, t AS (SELECT o_custkey, n, CAST((price - lag(price) OVER w) * lag(direction) OVER w AS DOUBLE) - 0.001 * CAST(price + lag(price) OVER w AS DOUBLE) AS profit FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY n))"""


@table_query("x14_round_trips", f"WITH {TRIPS} SELECT o_custkey, n, round(profit, 6) + 0.0 AS profit FROM t WHERE n % 2 = 0")
def x14(spark, sf_dir):
    g = ledger(spark, sf_dir).withColumn("price", F.col("price").cast("double"))
    return rounded(trades.round_trips(g, "o_custkey", "n", "price", "direction", 0.001))


@table_query("x17_drawdown", f"""WITH {TRIPS}, c AS (SELECT o_custkey, n, sum(profit) OVER (PARTITION BY o_custkey ORDER BY n) AS total FROM t WHERE n % 2 = 0),
p AS (SELECT *, max(total) OVER (PARTITION BY o_custkey ORDER BY n) AS peak FROM c) SELECT o_custkey, round(max(peak - total), 6) + 0.0 AS drawdown, round(max(peak), 6) + 0.0 AS peak FROM p GROUP BY o_custkey""")
def x17(spark, sf_dir):
    g = ledger(spark, sf_dir).withColumn("price", F.col("price").cast("double"))
    e = trades.equity(trades.round_trips(g, "o_custkey", "n", "price", "direction", 0.001), "o_custkey", "n")
    return e.groupBy("o_custkey").agg((F.round(F.max("drawdown"), 6) + 0.0).alias("drawdown"), (F.round(F.max("peak"), 6) + 0.0).alias("peak"))


@table_query("x16_portfolio_value", f"""WITH {LEDGER} SELECT o_custkey, n, round(CAST(sum(-price * direction) OVER w AS DOUBLE) - 0.001 * CAST(sum(price) OVER w AS DOUBLE), 6) + 0.0 AS cash, CAST(sum(direction) OVER w AS BIGINT) AS holding,
round(CAST(sum(-price * direction) OVER w AS DOUBLE) - 0.001 * CAST(sum(price) OVER w AS DOUBLE) + CAST(sum(direction) OVER w * price AS DOUBLE), 6) + 0.0 AS value FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY n)""")
def x16(spark, sf_dir):
    g = ledger(spark, sf_dir).withColumn("price", F.col("price").cast("double"))
    h = trades.holdings(g, "o_custkey", "n", "price", "direction", 0.001)
    return h.select("o_custkey", "n", (F.round("cash", 6) + 0.0).alias("cash"), "holding", (F.round("value", 6) + 0.0).alias("value"))


@query("x19_opportunity", "ticks", f"SELECT exchange, symbol, ts, seq, round(CAST(max(price) OVER w - price AS DOUBLE), 6) + 0.0 AS to_high, round(CAST(price - min(price) OVER w AS DOUBLE), 6) + 0.0 AS to_low FROM ticks WINDOW w AS ({W} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)")
def x19(t):
    return rounded(windows.near(t, lambda d, s: trades.opportunity(d, "price", 50, s), 50).select("exchange", "symbol", "ts", "seq", "to_high", "to_low"))


@query("x21_best_threshold", "ticks", """WITH c AS (SELECT *, sum(side * size) OVER (PARTITION BY exchange, symbol ORDER BY price DESC, seq) AS c FROM ticks)
SELECT exchange, symbol, CAST(arg_max(price, (c, -seq)) AS DOUBLE) AS threshold, CAST(max(c) AS DOUBLE) AS total FROM c GROUP BY exchange, symbol""")
def x21(t):
    return rounded(trades.best_threshold(t.withColumn("pnl", F.col("side") * F.col("size")), "price", "pnl", ["exchange", "symbol"]))


# ---- store, sets, arrays ----------------------------------------------------------------------------------


def hourly(t):
    h = t.groupBy("exchange", "symbol", "side", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("size").cast("double").alias("value"))
    tags = F.create_map(F.lit("measurement"), F.lit("bars"), F.lit("asset"), F.col("symbol"), F.lit("exchange"), F.col("exchange"), F.lit("side"), F.col("side").cast("string"))
    return h.select("ts", "value", tags.alias("tags"))


HOURLY = "h AS (SELECT exchange, symbol, CAST(side AS VARCHAR) AS side, date_trunc('hour', ts) AS ts, CAST(sum(size) AS DOUBLE) AS value FROM ticks GROUP BY ALL)"


@query("s18_tag_query", "ticks", f"""WITH {HOURLY} SELECT ts, max(value) FILTER (symbol = 'S0') AS "S0", max(value) FILTER (symbol = 'S1') AS "S1", max(value) FILTER (symbol = 'S2') AS "S2", max(value) FILTER (symbol = 'S3') AS "S3", max(value) FILTER (symbol = 'S4') AS "S4" FROM h WHERE side = '1' AND exchange = 'X' GROUP BY ts""")
def s18(t):
    found = store.matching(hourly(t), {"measurement": "bars", "exchange": "X", "side": "1"})
    named = found.withColumn("a", F.col("tags")["asset"])
    return named.groupBy("ts").pivot("a", [f"S{i}" for i in range(5)]).agg(F.first("value"))


@query("s19_column_names", "ticks", f"""WITH {HOURLY} SELECT DISTINCT symbol || '-' || exchange || '-bars-' || side AS name, md5('{{"asset":"' || symbol || '","exchange":"' || exchange || '","measurement":"bars","side":"' || side || '"}}') AS id FROM h""")
def s19(t):
    return hourly(t).select(store.column_name("tags", ["asset"]).alias("name"), store.series_id().alias("id")).distinct()


@query("s21_upsert", "ticks", f"""SELECT exchange, symbol, ts, seq, round(CAST(price + CASE WHEN seq % 4 = 0 THEN 1 ELSE 0 END AS DOUBLE), 6) AS price FROM ticks""")
def s21(t):
    rows = t.select("exchange", "symbol", "ts", "seq", "price")
    new = rows.where("seq % 4 = 0").withColumn("price", (F.col("price") + 1).cast("decimal(18,2)"))
    return rounded(store.upsert(rows, new, ["exchange", "symbol", "ts", "seq"]))


@query("s23_window_aggregate", "ticks", f"""WITH {HOURLY} SELECT md5('{{"asset":"' || symbol || '","exchange":"' || exchange || '","measurement":"bars","side":"' || side || '"}}') AS id, date_trunc('day', ts) AS ts, sum(value) AS value FROM h GROUP BY ALL""")
def s23(t):
    return store.window_aggregate(hourly(t), "1 day", F.sum)


@query("s36_lifetimes", "ticks", "SELECT exchange, symbol, min(ts) AS first, max(ts) AS last, count(*) AS n FROM ticks GROUP BY exchange, symbol")
def s36(t):
    return t.groupBy("exchange", "symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


@query("o03_latest_per_key", "ticks", "SELECT exchange, symbol, max(seq) AS seq, round(CAST(arg_max(price, seq) AS DOUBLE), 6) AS price FROM ticks GROUP BY exchange, symbol")
def o03(t):
    return rounded(t.groupBy("exchange", "symbol").agg(F.max("seq").alias("seq"), F.max_by("price", "seq").alias("price")))


@query("o05_set_operations", "ticks", """(SELECT seq % 1000 AS k FROM ticks WHERE symbol = 'S0' INTERSECT SELECT seq % 1000 FROM ticks WHERE side > 0) EXCEPT SELECT seq % 1000 FROM ticks WHERE price > 550""")
def o05(t):
    k = (F.col("seq") % 1000).alias("k")
    return t.where("symbol = 'S0'").select(k).intersect(t.where("side > 0").select(k)).subtract(t.where("price > 550").select(k))


@table_query("a05_json_props", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY event_type")
def a05(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type").agg(F.sum(F.from_json("props", "k INT")["k"]).alias("k"), F.count(F.lit(1)).alias("n"))
