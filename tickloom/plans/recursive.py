"""Queries over recursive indicators and ordered folds, with the recurrences written out in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import indicators as ta
from tickloom.operators import bars, book, trades, windows
from tickloom.plans.features import DAY, DAYS, D, LEDGER, day_series, ledger
from tickloom.plans.registry import query, rounded, table_query
from tickloom.plans.series import W, flow, with_price




def smooth(steps: list[tuple], source: str = "a") -> str:
    """CTEs that add exponential means one after another: (name, value, n, wilder, start) over the days of `source`; the last is `z`."""
    out, last = [], source
    for i, (name, value, n, wilder, start) in enumerate(steps):
        a = 1 - (1 / n if wilder else 2 / (n + 1))
        fold = f"list_reduce(list_prepend(list_avg(xs[{start - n + 1}:{start}]), xs[{start + 1}:]), lambda y, v: {a!r} * y + {1 - a!r} * v)"
        into = "z" if i == len(steps) - 1 else f"sz{i}"
        out.append(f"sx{i} AS (SELECT *, {value} AS xv FROM {last}), sy{i} AS (SELECT *, list(xv) FILTER (xv IS NOT NULL) OVER ({D}) AS xs FROM sx{i})")
        out.append(f"{into} AS (SELECT * EXCLUDE (xv, xs), CASE WHEN xv IS NOT NULL AND len(xs) >= {start} THEN {fold} END AS {name} FROM sy{i})")
        last = into
    return ", ".join(out)


def column(x: str, name: str, places: int = 5) -> str:
    return f"round({x}, {places}) + 0.0 AS {name}"


def days(df, *names, places: int = 5):
    return df.select(F.col("day").cast("string").alias("day"), *[(F.round(n, places) + 0.0).alias(n) for n in names])


@query("w06_ema", "daily", f"WITH {DAYS} SELECT {DAY}, {column('list_reduce(list_prepend(0.0, list(c) OVER (ORDER BY day)), lambda y, v: 0.9 * y + 0.1 * v)', 'ema')} FROM a")
def w06(d):
    """The plain recurrence from 0."""
    return days(windows.linear_scan(day_series(d), 0.9, 0.1 * F.col("close"), "ema", chunk=F.year("ts")), "ema")


_RETURNS = f"r AS (SELECT day, 1 + (c - lag(c) OVER ({D})) / c AS x FROM a)"
_WEIGHTED = "list_sum(list_transform(xs, lambda v, i: power({w}, len(xs) - i){v}))"
_SUMS = ", ".join(f"{_WEIGHTED.format(w=w, v=v)} AS {n}" for n, w, v in (("s", 9 / 11, ""), ("s2", (9 / 11) ** 2, ""), ("m", 9 / 11, " * (v - 1)"), ("q", 9 / 11, " * (v - 1) * (v - 1)")))


@query("w06_ewm_deviation", "daily", f"""WITH {DAYS}, {_RETURNS}, l AS (SELECT day, list(x) FILTER (x IS NOT NULL) OVER ({D}) AS xs FROM r), s AS (SELECT day, xs, {_SUMS} FROM l)
SELECT {DAY}, CASE WHEN len(xs) > 1 THEN {column('sqrt(greatest(q / s - power(m / s, 2), 0) * s * s / (s * s - s2))', 'x')[:-5]} END AS volatility FROM s""")
def w06_deviation(d):
    """Realised volatility by an exponentially weighted deviation of span 10."""
    x = windows.near(day_series(d), lambda r, s: r.withColumn("x", 1 + (F.col("close") - F.lag("close").over(windows.ordered(s))) / F.col("close")), 1)
    return days(ta.with_ewm_std(x, "x", 10, "volatility"), "volatility")


@query("g12_volatility_weighted", "ticks", f"""WITH r AS (SELECT exchange, symbol, ts, seq, row_number() OVER ({W}) AS i, 1 + (CAST(price AS DOUBLE) - lag(CAST(price AS DOUBLE)) OVER ({W})) / CAST(price AS DOUBLE) AS x FROM ticks),
l AS (SELECT *, list(x) FILTER (x IS NOT NULL) OVER ({W} ROWS 300 PRECEDING) AS xs FROM r), s AS (SELECT exchange, symbol, ts, seq, xs, {_SUMS} FROM l)
SELECT exchange, symbol, ts, seq, CASE WHEN len(xs) > 1 THEN {column('sqrt(greatest(q / s - power(m / s, 2), 0) * s * s / (s * s - s2))', 'x')[:-5]} END AS volatility FROM s""")
def g12_weighted(t):
    """The same over all ticks; the SQL looks 300 rows back, where weights are under 1e-26."""
    x = windows.near(with_price(t).select("exchange", "symbol", "ts", "seq", "p"), lambda r, s: r.withColumn("x", 1 + (F.col("p") - F.lag("p").over(windows.ordered(s))) / F.col("p")), 1).drop("p")
    out = ta.with_ewm_std(x, "x", 10, "volatility")
    return out.select("exchange", "symbol", "ts", "seq", (F.round("volatility", 5) + 0.0).alias("volatility"))


@query("t14_ema_and_macd", "daily", f"""WITH {DAYS}, {smooth([('ema12', 'c', 12, False, 12), ('slow', 'c', 26, False, 26), ('fast', 'c', 12, False, 26), ('sig', 'fast - slow', 9, False, 9)])}
SELECT {DAY}, {column('ema12', 'ema12')}, {column('fast - slow', 'macd')}, {column('sig', 'signal')}, {column('fast - slow - sig', 'hist')} FROM z""")
def t14(d):
    x = ta.with_mean(ta.with_macd(day_series(d), "close", 12, 26, 9), "close", 12, "ema12")
    return days(x, "ema12", "macd", "signal", "hist")


_FIX = "list_reduce(list_prepend(list_avg(xs[{first}:26]), xs[27:]), lambda y, v: {keep} * y + {rest} * v)"


@query("t14_macd_variants", "daily", f"""WITH {DAYS}, x AS (SELECT day, c, list(c) OVER ({D}) AS xs FROM a), f AS (SELECT day, CASE WHEN len(xs) >= 26 THEN {_FIX.format(first=15, keep=0.85, rest=0.15)} - {_FIX.format(first=1, keep=0.925, rest=0.075)} END AS fix,
CASE WHEN len(xs) >= 26 THEN avg(c) OVER ({D} ROWS 11 PRECEDING) - avg(c) OVER ({D} ROWS 25 PRECEDING) END AS ext FROM x)
SELECT {DAY}, {column('fix', 'macdfix')}, {column('ext', 'macdext')}, CASE WHEN count(ext) OVER ({D} ROWS 8 PRECEDING) = 9 THEN {column(f'avg(ext) OVER ({D} ROWS 8 PRECEDING)', 'x')[:-5]} END AS macdext_signal FROM f""")
def t14_variants(d):
    """MACD of fixed means, and of simple ones."""
    x = ta.with_macdext(ta.with_macdfix(day_series(d), "close"), "close", 12, 26, 9)
    return days(x, "macdfix", "macdext", "macdext_signal")


_SIX = smooth([(f"e{k}", f"e{k - 1}" if k > 1 else "c", 5, False, 5) for k in range(1, 7)])
_T3 = "-0.343 * e6 + (3 * 0.49 + 3 * 0.343) * e5 + (-6 * 0.49 - 3 * 0.7 - 3 * 0.343) * e4 + (1 + 3 * 0.7 + 0.343 + 3 * 0.49) * e3"


@query("t14_means_of_means", "daily", f"""WITH {DAYS}, {_SIX} SELECT {DAY}, {column('e1', 'ema')}, {column('2 * e1 - e2', 'dema')}, {column('3 * e1 - 3 * e2 + e3', 'tema')},
{column(f'100 * (e3 / lag(e3) OVER ({D}) - 1)', 'trix')}, {column(_T3, 't3')} FROM z""")
def t14_means(d):
    return days(ta.with_ema_family(day_series(d), "close", 5), "ema", "dema", "tema", "trix", "t3")


@query("t14_adaptive_mean", "daily", f"""WITH {DAYS}, b AS (SELECT *, row_number() OVER ({D}) AS i, abs(c - lag(c) OVER ({D})) AS d FROM a),
s AS (SELECT *, power(coalesce(abs(c - lag(c, 10) OVER ({D})) / nullif(sum(d) OVER ({D} ROWS 9 PRECEDING), 0), 1) * (2 / 3.0 - 2 / 31.0) + 2 / 31.0, 2) AS s FROM b),
l AS (SELECT day, i, list({{'a': CASE WHEN i > 10 THEN 1 - s ELSE 0.0 END, 'b': CASE WHEN i > 10 THEN s * c WHEN i = 10 THEN c ELSE 0.0 END}}) OVER ({D}) AS xs FROM s)
SELECT {DAY}, CASE WHEN i > 10 THEN {column("list_reduce(xs, lambda y, v: {'a': 0.0, 'b': v.a * y.b + v.b}).b", 'x')[:-5]} END AS kama FROM l""")
def t14_adaptive(d):
    return days(ta.with_kama(day_series(d), "close", 10), "kama")


_GAINS = f"g AS (SELECT *, c - lag(c) OVER ({D}) AS d FROM a)"
_RSI = _GAINS + ", " + smooth([("up", "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", 14, True, 14), ("down", "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END", 14, True, 14)], "g")


@query("t11_rsi", "daily", f"WITH {DAYS}, {_RSI} SELECT {DAY}, {column('100 * up / nullif(up + down, 0)', 'rsi')}, {column('100 * (up - down) / nullif(up + down, 0)', 'cmo')} FROM z")
def t11(d):
    return days(ta.with_rsi(day_series(d), "close", 14), "rsi", "cmo")


@query("t16_stochastic_rsi", "daily", f"""WITH {DAYS}, {_RSI}, r AS (SELECT day, 100 * up / nullif(up + down, 0) AS r FROM z),
k AS (SELECT day, CASE WHEN count(r) OVER w = 5 THEN coalesce(100 * (r - min(r) OVER w) / nullif(max(r) OVER w - min(r) OVER w, 0), 0) END AS k FROM r WINDOW w AS ({D} ROWS 4 PRECEDING))
SELECT {DAY}, {column('k', 'stochrsi_k')}, CASE WHEN count(k) OVER ({D} ROWS 2 PRECEDING) = 3 THEN {column(f'avg(k) OVER ({D} ROWS 2 PRECEDING)', 'x')[:-5]} END AS stochrsi_d FROM k""")
def t16_stochastic(d):
    return days(ta.with_stochrsi(day_series(d), "close", 14, 5, 3), "stochrsi_k", "stochrsi_d")


_RANGES = f"g AS (SELECT *, CASE WHEN lag(c) OVER ({D}) IS NOT NULL THEN greatest(h - l, abs(h - lag(c) OVER ({D})), abs(l - lag(c) OVER ({D}))) END AS tr FROM a)"


@query("t12_average_true_range", "daily", f"WITH {DAYS}, {_RANGES}, {smooth([('atr', 'tr', 14, True, 14)], 'g')} SELECT {DAY}, {column('atr', 'atr')}, {column('100 * atr / c', 'natr')} FROM z")
def t12_average(d):
    return days(ta.with_atr(day_series(d), "high", "low", "close", 14), "atr", "natr")


_FLOWS = f"g AS (SELECT day, row_number() OVER ({D}) AS i, sum(CASE WHEN h <> l THEN ((c - l) - (h - c)) / (h - l) * v ELSE 0 END) OVER ({D}) AS ad FROM a)"


@query("t13_accumulation_oscillator", "daily", f"""WITH {DAYS}, {_FLOWS}, {smooth([('fast', 'ad', 3, False, 1), ('slow', 'ad', 10, False, 1)], 'g').replace('xs[-1:1]', 'xs[1:1]').replace('xs[-8:1]', 'xs[1:1]')}
SELECT {DAY}, CASE WHEN i >= 10 THEN {column('fast - slow', 'x')[:-5]} END AS adosc FROM z""")
def t13_oscillator(d):
    return days(ta.with_adosc(day_series(d), "high", "low", "close", "volume", 3, 10), "adosc")


# ---- folds with resets, row by row in SQL -----------------------------------------------------------------

_ROWS = f"i AS MATERIALIZED (SELECT *, row_number() OVER ({W}) AS i FROM {{view}})"
_NEXT = "JOIN i ON i.exchange = r.exchange AND i.symbol = r.symbol AND i.i = r.i + 1"


@query("g07_sequence_bars", "ticks", f"""WITH RECURSIVE i AS MATERIALIZED (SELECT exchange, symbol, ts, CAST(side * size AS DECIMAL(38,10)) AS m, row_number() OVER ({W}) AS i FROM ticks),
r AS (SELECT exchange, symbol, ts, CAST(0 AS BIGINT) AS i, 0::DECIMAL(38,10) AS up, 0::DECIMAL(38,10) AS down, 0 AS s FROM i WHERE i = 1 UNION ALL
SELECT i.exchange, i.symbol, i.ts, i.i, CASE WHEN u >= 20 OR d >= 20 THEN 0 ELSE u END, CASE WHEN u >= 20 OR d >= 20 THEN 0 ELSE d END, CASE WHEN u >= 20 THEN 1 WHEN d >= 20 THEN -1 ELSE 0 END
FROM (SELECT i.exchange, i.symbol, i.ts, i.i, r.up + greatest(m, 0) AS u, r.down + greatest(-m, 0) AS d FROM r {_NEXT}) i)
SELECT exchange, symbol, ts, CAST(sum(s) AS INT) AS sequence FROM r WHERE i > 0 GROUP BY exchange, symbol, ts HAVING sum(s) <> 0""")
def g07(t):
    out = bars.sequence_bars(t, flow(), 20.0)
    return out.withColumn("sequence", F.col("sequence").cast("int"))


@query("b07_delta_sampling", "ticks", f"""WITH RECURSIVE i AS MATERIALIZED (SELECT exchange, symbol, ts, seq, CAST(price AS DOUBLE) AS p, row_number() OVER ({W}) AS i FROM ticks),
r AS (SELECT exchange, symbol, ts, seq, p, i, p AS kept, true AS k FROM i WHERE i = 1 UNION ALL
SELECT i.exchange, i.symbol, i.ts, i.seq, i.p, i.i, CASE WHEN abs(i.p - r.kept) >= 25 THEN i.p ELSE r.kept END, abs(i.p - r.kept) >= 25 FROM r {_NEXT})
SELECT exchange, symbol, ts, seq, p FROM r WHERE k""")
def b07(t):
    return bars.delta_sampling(with_price(t), "p", 25.0)


_BOOK = """b AS (SELECT exchange, symbol, CAST(ts AS DATE) AS d, ts, seq, CAST(price AS DOUBLE) AS price, size, count, row_number() OVER (PARTITION BY exchange, symbol, CAST(ts AS DATE) ORDER BY ts, seq) AS i FROM l2)"""
_OWN = "list_filter({own}, lambda x: x <> j.price)"
_BOOKS = f"""{_BOOK}, r AS (SELECT exchange, symbol, d, ts, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS i, CAST([] AS DOUBLE[]) AS bids, CAST([] AS DOUBLE[]) AS asks FROM b WHERE i = 1 UNION ALL
SELECT j.exchange, j.symbol, j.d, j.ts, j.seq, j.i,
CASE WHEN j.size > 0 AND j.count <> 0 THEN list_append({_OWN.format(own='r.bids')}, j.price) WHEN j.size > 0 THEN {_OWN.format(own='r.bids')} WHEN j.count <> 0 THEN list_filter(r.bids, lambda x: x < j.price) ELSE r.bids END,
CASE WHEN j.size <= 0 AND j.count <> 0 THEN list_append({_OWN.format(own='r.asks')}, j.price) WHEN j.size <= 0 THEN {_OWN.format(own='r.asks')} WHEN j.count <> 0 THEN list_filter(r.asks, lambda x: x > j.price) ELSE r.asks END
FROM r JOIN b j ON j.exchange = r.exchange AND j.symbol = r.symbol AND j.d = r.d AND j.i = r.i + 1)"""


@query("b01_best_prices", "l2", f"WITH RECURSIVE {_BOOKS} SELECT exchange, symbol, ts, seq, list_max(bids) AS best_bid, list_min(asks) AS best_ask FROM r WHERE i > 0")
def b01(b):
    return bars.best_prices(b)


@query("b02_clean_book", "l2", f"WITH RECURSIVE {_BOOKS} SELECT exchange, symbol, ts, seq, array_to_string(list_transform(list_sort(bids), lambda x: printf('%.1f', x)), ' ') AS bids, array_to_string(list_transform(list_sort(asks), lambda x: printf('%.1f', x)), ' ') AS asks FROM r WHERE i > 0")
def b02(b):
    """The levels of both sides after each update, crossed and emptied ones taken out."""
    text = lambda side: F.array_join(F.transform(F.col(side), lambda x: F.format_string("%.1f", x["price"])), " ")
    return bars.clean_book(b).select("exchange", "symbol", "ts", "seq", text("bids").alias("bids"), text("asks").alias("asks"))


@query("b02_clean_updates", "l2", f"""WITH RECURSIVE {_BOOKS}, be AS (SELECT exchange, symbol, ts, seq, list_max(bids) AS bb, list_min(asks) AS ba FROM r WHERE i > 0),
fb AS (SELECT exchange, symbol, ts, seq, {', '.join(f'coalesce(last_value({c} IGNORE NULLS) OVER ({W}), first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}' for c in ('bb', 'ba'))} FROM be),
u AS (SELECT exchange, symbol, ts, seq, CAST(price AS DOUBLE) AS price, size, count, bb, ba, CASE WHEN size > 0 THEN 1 ELSE -1 END AS s FROM l2 JOIN fb USING (exchange, symbol, ts, seq)),
v AS (SELECT *, CASE WHEN coalesce(CASE WHEN s > 0 THEN price > bb ELSE price < ba END, false) THEN -s ELSE s END AS side FROM u WHERE NOT coalesce(bb < price AND price < ba, false))
SELECT exchange, symbol, ts, seq, side, price, CAST(CASE WHEN count = 0 THEN 0 ELSE size END AS BIGINT) AS size, bb AS best_bid, ba AS best_ask, CAST(abs(round_even(CASE WHEN side > 0 THEN bb - price ELSE price - ba END / 0.5, 0) + 1) AS INT) AS level FROM v""")
def b02_updates(b):
    """Updates between the best prices dropped, sides put right, levels counted from the best price."""
    out = book.clean_updates(b, 0.5)
    return out.select("exchange", "symbol", "ts", "seq", "side", "price", F.col("size").cast("long").alias("size"), "best_bid", "best_ask", "level")


_SAR = """s0 AS MATERIALIZED (SELECT day, h, l, row_number() OVER (ORDER BY day) AS i FROM a),
{n} AS (SELECT i, l AS bl, h AS bh, 0 AS side, 0.0::DOUBLE AS stop, 0.0::DOUBLE AS best, 0.0::DOUBLE AS share, CAST(NULL AS DOUBLE) AS v FROM s0 WHERE i = 1 UNION ALL
SELECT i, l, h, side, least(CASE WHEN nshare > 0 THEN stop + nshare * (nbest - stop) END, CASE WHEN side > 0 THEN ol ELSE -oh END, CASE WHEN side > 0 THEN l ELSE -h END), nbest, nshare, CASE WHEN {signed} THEN stop ELSE stop * side END FROM (
SELECT *, CASE WHEN NOT turned AND far > best THEN far ELSE best END AS nbest, CASE WHEN NOT turned AND far > best THEN least(share + {step}, {most}) ELSE share END AS nshare FROM (
SELECT i, l, h, ol, oh, turned, CASE WHEN turned THEN -side ELSE side END AS side, CASE WHEN turned THEN least(-best, CASE WHEN side < 0 THEN ol ELSE -oh END, CASE WHEN side < 0 THEN l ELSE -h END) ELSE stop END AS stop,
CASE WHEN turned THEN (CASE WHEN side < 0 THEN h ELSE -l END) ELSE best END AS best, CASE WHEN turned THEN {step} ELSE share END AS share, CASE WHEN (side > 0) <> turned THEN h ELSE -l END AS far FROM (
SELECT *, CASE WHEN side > 0 THEN l ELSE -h END <= stop AS turned FROM (
SELECT j.i, j.l, j.h, CASE WHEN r.side = 0 THEN j.l ELSE r.bl END AS ol, CASE WHEN r.side = 0 THEN j.h ELSE r.bh END AS oh,
CASE WHEN r.side <> 0 THEN r.side WHEN r.bl - j.l > greatest(j.h - r.bh, 0) THEN -1 ELSE 1 END AS side,
CASE WHEN r.side <> 0 THEN r.stop WHEN r.bl - j.l > greatest(j.h - r.bh, 0) THEN -r.bh ELSE r.bl END AS stop,
CASE WHEN r.side <> 0 THEN r.best WHEN r.bl - j.l > greatest(j.h - r.bh, 0) THEN -j.l ELSE j.h END AS best,
CASE WHEN r.side <> 0 THEN r.share ELSE {step} END AS share FROM {n} r JOIN s0 j ON j.i = r.i + 1)))))"""


@query("t19_parabolic_stop", "daily", f"""WITH RECURSIVE {DAYS}, {_SAR.format(n='p', step='0.02::DOUBLE', most='0.2::DOUBLE', signed='false')}, {_SAR.format(n='q', step='0.01::DOUBLE', most='0.1::DOUBLE', signed='true').partition('),')[2].lstrip()}
SELECT {DAY}, {column('p.v', 'sar', 6)}, {column('q.v', 'sarext', 6)} FROM s0 JOIN p USING (i) JOIN q USING (i)""")
def t19(d):
    x = ta.with_sar(day_series(d), "high", "low")
    return days(ta.with_sar(x, "high", "low", 0.01, 0.1, True, "sarext"), "sar", "sarext", places=6)


_TIMED = LEDGER + """, o AS (SELECT *, CASE WHEN n % 2 = 1 THEN 'entry' ELSE 'exit' END AS timing FROM g)"""


@table_query("x18_position_sizes", f"""WITH {_TIMED}, k AS (SELECT *, lag(timing) OVER w AS b, CASE WHEN timing = 'entry' AND coalesce(lag(timing) OVER w, 'exit') = 'exit' THEN direction END AS opened FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY n))
SELECT o_custkey, n, CAST(CASE WHEN opened IS NOT NULL THEN direction WHEN timing = 'exit' AND b = 'entry' THEN -last_value(opened IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY n) ELSE 0 END AS INT) AS quantity FROM k""")
def x18(spark, sf_dir):
    return trades.position_sizes(ledger(spark, sf_dir), "o_custkey", "n", "direction", "timing")


@table_query("x18_convex_sizes", f"""WITH RECURSIVE {_TIMED}, r AS (SELECT o_custkey, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS held, 0 AS wins, false AS won, 0.0::DOUBLE AS price, 0.0::DOUBLE AS q FROM o WHERE n = 1 UNION ALL
SELECT o_custkey, n, held + q, wins + w, CASE WHEN earns THEN w = 1 ELSE won END, price, q FROM (
SELECT *, CASE WHEN skip THEN 0 WHEN timing = 'exit' THEN -held WHEN n = 1 THEN direction ELSE direction * cap - held END AS q, CASE WHEN earns AND profit > 0 THEN 1 ELSE 0 END AS w FROM (
SELECT o.o_custkey, o.n, o.direction, o.timing, CAST(o.price AS DOUBLE) AS price, r.held, r.wins, r.won, r.held * o.direction >= 1 AS skip, r.held * o.direction < 1 AND o.n > 1 AS earns, (r.price - CAST(o.price AS DOUBLE)) * o.direction AS profit,
CASE WHEN r.won OR r.wins = 0 THEN 1.0 ELSE 1.0 / (r.wins * 2) END AS cap FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.n = r.n + 1)))
SELECT o_custkey, n, round(q, 6) + 0.0 AS quantity FROM r WHERE n > 0""")
def x18_convex(spark, sf_dir):
    g = ledger(spark, sf_dir).withColumn("price", F.col("price").cast("double"))
    return rounded(trades.convex_sizes(g, "o_custkey", "n", "direction", "timing", "price"))
