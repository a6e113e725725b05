"""Technical indicators as columns over (exchange, symbol) series ordered by (ts, seq)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.recurrences import mean, recurrence, scan
from tickloom.operators.windows import SERIES, _small_join, fold_ordered, full, near, ordered, running, trailing


def _roll(agg: Column, value: str, n: int) -> Column:
    return full(F.col(value), agg, n, trailing(n))


def mom(x: str, n: int) -> Column:
    return F.col(x) - F.lag(x, n).over(ordered())


def roc(x: str, n: int) -> Column:
    return 100 * (F.col(x) / F.lag(x, n).over(ordered()) - 1)


def sma(x: str, n: int) -> Column:
    return _roll(F.avg(x), x, n)


def wma(x: str, n: int) -> Column:
    """Linearly weighted mean, the latest row weighing n."""
    w = trailing(n)
    weighted = F.aggregate(
        F.transform(F.collect_list(x).over(w), lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v
    )
    return F.when(F.count(x).over(w) == n, weighted / (n * (n + 1) / 2))


def trima(x: str, n: int) -> Column:
    """Triangularly weighted mean: the middle of n rows weighs most."""
    w = trailing(n)
    weight = lambda i: F.least(i + 1, n - i)
    weighted = F.aggregate(F.transform(F.collect_list(x).over(w), lambda v, i: v * weight(i)), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.count(x).over(w) == n, weighted / sum(min(i + 1, n - i) for i in range(n)))


def midprice(h: str, lo: str, n: int) -> Column:
    w = trailing(n)
    return F.when(F.count(F.lit(1)).over(w) == n, (F.max(h).over(w) + F.min(lo).over(w)) / 2)


def extreme_rows(x: str, row: str, n: int) -> tuple[Column, Column]:
    """`row` of the largest and of the smallest of n values, the latest on ties."""
    w = trailing(n)
    top, low = F.max(F.struct(x, row)).over(w)[row], -F.min(F.struct(F.col(x), (-F.col(row)).alias("r"))).over(w)["r"]
    ready = F.count(x).over(w) == n
    return F.when(ready, top), F.when(ready, low)


def midpoint(x: str, n: int) -> Column:
    w = trailing(n)
    return F.when(F.count(x).over(w) == n, (F.max(x).over(w) + F.min(x).over(w)) / 2)


def stddev(x: str, n: int, k: float = 1.0) -> Column:
    """Population deviation of n rows, k times."""
    return k * _roll(F.stddev_pop(x), x, n)


def variance(x: str, n: int) -> Column:
    return _roll(F.var_pop(x), x, n)


def bbands(x: str, n: int, k: float) -> tuple[Column, Column, Column]:
    mid, dev = sma(x, n), _roll(F.stddev_pop(x), x, n)
    return mid + k * dev, mid, mid - k * dev


def aroon(high: str, low: str, n: int) -> tuple[Column, Column]:
    """Up and down: 100 * (n - rows since the latest extreme of n + 1 rows) / n."""
    w = trailing(n + 1)
    ready = F.count(F.lit(1)).over(w) == n + 1

    def value(c: str, best) -> Column:
        rows = F.reverse(F.collect_list(c).over(w))
        return F.when(ready, 100.0 * (n - (F.array_position(rows, best(rows)) - 1)) / n)

    return value(high, F.array_max), value(low, F.array_min)


def bop(o: str, h: str, lo: str, c: str) -> Column:
    return F.when(F.col(h) != F.col(lo), (F.col(c) - F.col(o)) / (F.col(h) - F.col(lo))).otherwise(0.0)


def cci(h: str, lo: str, c: str, n: int) -> Column:
    w = trailing(n)
    typical = (F.col(h) + F.col(lo) + F.col(c)) / 3
    rows, mean = F.collect_list(typical).over(w), F.avg(typical).over(w)
    deviation = F.aggregate(F.transform(rows, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, v: a + v) / n
    return F.when(F.count(F.lit(1)).over(w) == n, F.when(deviation != 0, (typical - mean) / (0.015 * deviation)).otherwise(0.0))


def willr(h: str, lo: str, c: str, n: int) -> Column:
    w = trailing(n)
    top, low = F.max(h).over(w), F.min(lo).over(w)
    return F.when(F.count(F.lit(1)).over(w) == n, F.when(top != low, -100 * (top - F.col(c)) / (top - low)).otherwise(0.0))


def stoch_k(h: str, lo: str, c: str, n: int) -> Column:
    return 100 + willr(h, lo, c, n)


def with_stochastics(df: DataFrame, h: str, lo: str, c: str, n: int, smooth: int) -> DataFrame:
    """fast_k of n rows (0 where they are flat), fast_d and slow_k, its mean of `smooth` rows, and slow_d, the mean of slow_k."""
    w = trailing(n)
    top, low = F.max(h).over(w), F.min(lo).over(w)
    k = F.when(F.count(F.lit(1)).over(w) == n, F.when(top != low, 100 * (F.col(c) - low) / (top - low)).otherwise(0.0))
    x = df.withColumn("fast_k", k).withColumn("fast_d", sma("fast_k", smooth)).withColumn("slow_k", F.col("fast_d"))
    return x.withColumn("slow_d", sma("slow_k", smooth))


def true_range(h: str, lo: str, c: str) -> Column:
    prev = F.lag(c).over(ordered())
    return F.greatest(F.col(h) - F.col(lo), F.abs(F.col(h) - prev), F.abs(F.col(lo) - prev))


def apo(x: str, fast: int, slow: int) -> Column:
    return sma(x, fast) - sma(x, slow)


def ppo(x: str, fast: int, slow: int) -> Column:
    return 100 * (sma(x, fast) - sma(x, slow)) / sma(x, slow)


def obv(c: str, volume: str) -> Column:
    step = F.signum(F.col(c) - F.lag(c).over(ordered())) * F.col(volume)
    return F.coalesce(step, F.col(volume).cast("double"))


def ad_step(h: str, lo: str, c: str, volume: str) -> Column:
    spread = F.col(h) - F.col(lo)
    return F.when(spread != 0, ((F.col(c) - F.col(lo)) - (F.col(h) - F.col(c))) / spread * F.col(volume)).otherwise(0.0)


def cumulative(step: str) -> Column:
    return F.sum(step).over(running())


def with_mfi(df: DataFrame, h: str, lo: str, c: str, volume: str, n: int, name: str = "mfi") -> DataFrame:
    """Money flow index: share of rising typical prices in the notional of n rows, in percent; the first row has no direction."""
    w, typical = trailing(n), (F.col(h) + F.col(lo) + F.col(c)) / 3
    x = df.withColumn("__t", typical).withColumn("__d", F.col("__t") - F.lag("__t").over(ordered()))
    flow = F.when(F.col("__d") != 0, F.col("__t") * F.col(volume)).when(F.col("__d") == 0, 0.0)
    up = F.when(F.col("__d") > 0, flow).when(F.col("__d").isNotNull(), 0.0)
    value = F.when(F.count(flow).over(w) == n, F.coalesce(100 * F.sum(up).over(w) / F.nullif(F.sum(flow).over(w), F.lit(0.0)), F.lit(0.0)))
    return x.withColumn(name, value).drop("__t", "__d")


def regression(y: str, x: str, n: int) -> tuple[Column, Column]:
    """Slope and fitted value at the current row of y on x over n rows."""
    w = trailing(n)
    ready = F.count(y).over(w) == n
    slope, base = F.regr_slope(y, x).over(w), F.regr_intercept(y, x).over(w)
    return F.when(ready, slope), F.when(ready, base + slope * F.col(x))


def _with_last(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns of the row before (name -> source)."""
    return near(df, lambda d, key: d.withColumns({k: F.lag(v).over(ordered(key)) for k, v in columns.items()}), 1)


def _range(h: str, lo: str, last: str) -> Column:
    return F.greatest(F.col(h) - F.col(lo), F.abs(F.col(h) - F.col(last)), F.abs(F.col(lo) - F.col(last)))


def with_directional(df: DataFrame, h: str, lo: str, c: str, n: int, rows: int = 0) -> DataFrame:
    """Directional movement by smoothing with 1/n from 0: plus_dm, minus_dm, plus_di, minus_di, dx, adx, adxr; null in the first n rows.

    Two recurrences, one on what comes of the other.
    """
    keep = (n - 1) / n
    up, down = F.col(h) - F.col("__h"), F.col("__l") - F.col(lo)
    moved = lambda x, y: F.when(F.col("__h").isNull(), 0.0).otherwise(F.when((x > y) & (x > 0), x).otherwise(0.0))
    x = _with_last(df, {"__h": h, "__l": lo, "__p": c})
    x = x.withColumns({"__up": moved(up, down), "__down": moved(down, up), "__reach": F.when(F.col("__p").isNull(), F.col(h) - F.col(lo)).otherwise(_range(h, lo, "__p"))})

    def sums(x, state, zero):
        state = np.zeros(4) if state is None else state
        out = [scan(keep, v * (not zero), s) for v, s in zip(x, state)] + [state[3] + np.arange(1, len(x[0]) + 1) * (not zero)]
        return out, [v[-1] for v in out]

    def smooth(x, state, zero):
        out = scan(keep, x[0] / n * (not zero), 0.0 if state is None else state[0])
        return [out], [out[-1]]

    made = ["plus_dm", "minus_dm", "__total", "__i"]
    x = recurrence(x, ["__up", "__down", "__reach"], made, sums, 4, rows=rows)
    both = F.col("plus_dm") + F.col("minus_dm")
    x = x.withColumn("dx", F.when((F.col("__total") != 0) & (both != 0), 100 * F.abs(F.col("plus_dm") - F.col("minus_dm")) / both).otherwise(0.0))
    x = recurrence(x, ["dx"], ["adx"], smooth, 1, rows=rows)
    x = near(x, lambda d, key: d.withColumn("__old", F.lag("adx", n - 1).over(ordered(key))), n - 1)
    share = lambda c: 100 * F.col(c) / F.nullif(F.col("__total"), F.lit(0.0))
    values = {"plus_di": share("plus_dm"), "minus_di": share("minus_dm"), "adxr": (F.col("adx") + F.col("__old")) / 2} | {k: F.col(k) for k in ("plus_dm", "minus_dm", "dx", "adx")}
    return x.withColumns({k: F.when(F.col("__i") > n, v) for k, v in values.items()}).drop("__h", "__l", "__p", "__up", "__down", "__reach", "__total", "__i", "__old")


def with_mean(df: DataFrame, x: str, n: int, name: str, rows: int = 0) -> DataFrame:
    """Exponential mean that begins with the mean of the first n values."""

    def run(x, state, zero):
        out = mean(x[0] * (not zero), n, None if state is None else state[0])
        return [out], [out[-1]]

    return recurrence(df, [x], [name], run, 1, n, rows=rows)


def with_ema_family(df: DataFrame, x: str, n: int, rows: int = 0) -> DataFrame:
    """ema, dema, tema, trix and t3 (factor 0.7) of n rows: means of means, up to six deep."""
    v = 0.7
    weights = (1 + 3 * v + v**3 + 3 * v**2, -6 * v**2 - 3 * v - 3 * v**3, 3 * v**2 + 3 * v**3, -(v**3))

    def run(x, state, zero):
        e, value = [], x[0] * (not zero)
        for k in range(6):
            value = mean(value, n, None if state is None else state[k])
            e.append(value)
        last = np.append(np.nan if state is None else state[2], e[2][:-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            trix = 100 * (e[2] / last - 1)
        t3 = sum(w * y for w, y in zip(weights, e[2:]))
        return [e[0], 2 * e[0] - e[1], 3 * e[0] - 3 * e[1] + e[2], trix, t3], [y[-1] for y in e]

    return recurrence(df, [x], ["ema", "dema", "tema", "trix", "t3"], run, 6, 6 * n, rows=rows)


def with_macd(df: DataFrame, x: str, fast: int, slow: int, signal: int, rows: int = 0, names: tuple[str, str, str] = ("macd", "signal", "hist")) -> DataFrame:
    """macd (fast mean less slow mean, both from row `slow` on), its `signal` mean and their difference `hist`."""

    def run(x, state, zero):
        state = [None] * 3 if state is None else state
        value = x[0] * (not zero)
        quick, long = mean(value, fast, state[0], start=slow), mean(value, slow, state[1])
        line = mean(quick - long, signal, state[2])
        return [np.where(np.isnan(long), np.nan, quick - long), line, quick - long - line], [quick[-1], long[-1], line[-1]]

    return recurrence(df, [x], list(names), run, 3, slow + signal, rows=rows)


def with_macdfix(df: DataFrame, x: str, signal: int = 9, rows: int = 0) -> DataFrame:
    """macdfix, macdfix_signal, macdfix_hist: as `with_macd` with fixed means that keep 1 - 0.15 and 1 - 0.075 of what was."""

    def run(x, state, zero):
        state = [None] * 3 if state is None else state
        value = x[0] * (not zero)
        parts = []
        for keep, n, before in ((0.85, 12, state[0]), (0.925, 26, state[1])):
            if before is None:
                out = np.full(len(value), np.nan)
                if len(value) >= 26:
                    out[25] = value[26 - n : 26].mean()
                    out[26:] = scan(keep, (1 - keep) * value[26:], out[25])
            else:
                out = scan(keep, (1 - keep) * value, before)
            parts.append(out)
        macd = parts[0] - parts[1]
        line = mean(macd, signal, state[2])
        return [macd, line, macd - line], [parts[0][-1], parts[1][-1], line[-1]]

    return recurrence(df, [x], ["macdfix", "macdfix_signal", "macdfix_hist"], run, 3, 26 + signal, rows=rows)


def with_macdext(df: DataFrame, x: str, fast: int, slow: int, signal: int) -> DataFrame:
    """macdext, macdext_signal, macdext_hist with simple means in place of exponential ones."""
    line = lambda d, key: d.withColumn("macdext", full(F.col(x), F.avg(x), fast, trailing(fast, key)) - full(F.col(x), F.avg(x), slow, trailing(slow, key)))
    rows = near(df, line, slow - 1).withColumn("macdext", F.when(F.col("macdext").isNotNull(), F.col("macdext")))
    mean_ = lambda d, key: d.withColumn("macdext_signal", full(F.col("macdext"), F.avg("macdext"), signal, trailing(signal, key)))
    return near(rows, mean_, signal - 1).withColumn("macdext_hist", F.col("macdext") - F.col("macdext_signal"))


def with_kama(df: DataFrame, x: str, n: int, fast: int = 2, slow: int = 30, name: str = "kama", rows: int = 0) -> DataFrame:
    """Adaptive mean: it moves towards the price by the square of a share between those of the fast and the slow mean, by how
    straight the last n steps are. It starts at the price of row n and is null up to there."""
    hi, lo = 2 / (fast + 1), 2 / (slow + 1)

    def shares(d: DataFrame, key) -> DataFrame:
        w = ordered(key)
        d = d.withColumn("__d", F.abs(F.col(x) - F.lag(x).over(w)))
        way = F.sum("__d").over(trailing(n, key))
        straight = F.coalesce(F.abs(F.col(x) - F.lag(x, n).over(w)) / F.nullif(way, F.lit(0.0)), F.lit(1.0))
        return d.withColumn("__share", F.pow(straight * (hi - lo) + lo, F.lit(2))).drop("__d")

    def run(x, state, zero):
        value, share = x
        if state is not None:
            out = scan(1 - share, share * value * (not zero), state[0])
        else:
            out = np.full(len(value), np.nan)
            if len(value) > n:
                out[n:] = scan(1 - share[n:], share[n:] * value[n:], value[n - 1])
        return [out], [out[-1]]

    return recurrence(near(df, shares, n), [x, "__share"], [name], run, 1, n + 1, rows=rows).drop("__share")


def with_rsi(df: DataFrame, x: str, n: int, rows: int = 0) -> DataFrame:
    """rsi and cmo of n rows: Wilder means of gains and losses, null in the first n rows; 0 where nothing moves."""

    def run(x, state, zero):
        state = [None] * 2 if state is None else state
        d = x[0] * (not zero)
        up, down = mean(np.maximum(d, 0.0), n, state[0], wilder=True), mean(np.maximum(-d, 0.0), n, state[1], wilder=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            still = up + down == 0
            return [np.where(still, 0.0, 100 * up / (up + down)), np.where(still, 0.0, 100 * (up - down) / (up + down))], [up[-1], down[-1]]

    moved = _with_last(df, {"__p": x}).withColumn("__d", F.col(x) - F.col("__p"))
    return recurrence(moved, ["__d"], ["rsi", "cmo"], run, 2, n, rows=rows).drop("__p", "__d")


def with_stochrsi(df: DataFrame, x: str, n: int, k: int, d: int) -> DataFrame:
    """stochrsi_k: where the rsi stands between its extremes of k rows, in percent; stochrsi_d, its mean of d rows."""

    def stood(r: DataFrame, key) -> DataFrame:
        w = trailing(k, key)
        top, low = F.max("rsi").over(w), F.min("rsi").over(w)
        value = F.when(top != low, 100 * (F.col("rsi") - low) / (top - low)).otherwise(0.0)
        return r.withColumn("stochrsi_k", F.when(F.count("rsi").over(w) == k, value))

    rows = near(with_rsi(df, x, n).drop("cmo"), stood, k - 1)
    return near(rows, lambda r, key: r.withColumn("stochrsi_d", full(F.col("stochrsi_k"), F.avg("stochrsi_k"), d, trailing(d, key))), d - 1)


def with_atr(df: DataFrame, h: str, lo: str, c: str, n: int, rows: int = 0) -> DataFrame:
    """atr, the Wilder mean of the true range from the second row on, and natr, in percent of the close."""

    def run(x, state, zero):
        out = mean(x[0] * (not zero), n, None if state is None else state[0], wilder=True)
        return [out], [out[-1]]

    ranges = _with_last(df, {"__p": c}).withColumn("__r", F.when(F.col("__p").isNotNull(), _range(h, lo, "__p")))
    return recurrence(ranges, ["__r"], ["atr"], run, 1, n, rows=rows).withColumn("natr", 100 * F.col("atr") / F.col(c)).drop("__p", "__r")


def with_adosc(df: DataFrame, h: str, lo: str, c: str, volume: str, fast: int, slow: int, rows: int = 0) -> DataFrame:
    """Fast less slow exponential mean of the accumulation line, both starting at its first value; null until the slow one is full."""

    def run(x, state, zero):
        before = [0.0, None, None] if state is None else state
        line = before[0] + np.cumsum(x[0] * (not zero))
        a, b = (mean(line, n, s, start=1) for n, s in ((fast, before[1]), (slow, before[2])))
        out = a - b
        if state is None:
            out[: slow - 1] = np.nan
        return [out], [line[-1], a[-1], b[-1]]

    return recurrence(df.withColumn("__a", ad_step(h, lo, c, volume)), ["__a"], ["adosc"], run, 3, slow, rows=rows).drop("__a")


def with_ewm_std(df: DataFrame, x: str, span: int, name: str, rows: int = 0) -> DataFrame:
    """Exponentially weighted standard deviation, weights by age (the first row weighs too) and without bias; null for one value.

    It comes from the sums of weights, of squared weights, of values and of squared values, taken from the middle of the series' extremes.
    A null value has no weight but ages the others.
    """
    a = 1 - 2 / (span + 1)

    def run(x, state, zero):
        there = ~np.isnan(x[0])
        value = np.where(there, x[0], 0.0) * (not zero)
        weight = there * (0.0 if zero else 1.0)
        parts = ((a, weight), (a * a, weight), (a, value), (a, value * value))
        w, w2, s, q = sums = [scan(k, v, before) for (k, v), before in zip(parts, np.zeros(4) if state is None else state)]
        free = w * w - w2
        with np.errstate(divide="ignore", invalid="ignore"):
            dev = np.sqrt(np.maximum(q - s * s / w, 0.0) * w / free)
        return [np.where(there & (free > 1e-12 * w * w), dev, np.nan)], [y[-1] for y in sums]

    middle = df.groupBy(*SERIES).agg(((F.min(x) + F.max(x)) / 2).alias("__m"))
    shifted = _small_join(df, middle, list(SERIES)).withColumn("__x", F.col(x) - F.col("__m"))
    return recurrence(shifted, ["__x"], [name], run, 4, nulls=True, rows=rows).drop("__m", "__x")


def with_sar(df: DataFrame, h: str, lo: str, step: float = 0.02, most: float = 0.2, signed: bool = False, name: str = "sar") -> DataFrame:
    """Parabolic stop: it moves towards the extreme by a share that grows with each new one, never past the last two bars, and turns where
    it is touched. With `signed` it is negative while short. It turns on its own past, so this is an ordered fold whose state is the
    last two bars, side, stop, extreme and share."""
    names = df.columns
    high, low = names.index(h), names.index(lo)

    def fold(state, row):
        bar = (row[low], row[high])
        if state is None:
            return (bar,), (*row, None)
        before = state[0]
        if len(state) == 1:
            fall, rise = before[0] - bar[0], bar[1] - before[1]
            side = -1 if fall > max(rise, 0) else 1
            stop, best, share, older = (before[0] if side > 0 else -before[1]), (bar[1] if side > 0 else -bar[0]), step, bar
        else:
            _, side, stop, best, share = state
            older = before
        near_ = lambda b: b[0] if side > 0 else -b[1]  # noqa: E731  the end of a bar that can touch the stop
        far = lambda b: b[1] if side > 0 else -b[0]
        turned = near_(bar) <= stop
        if turned:
            side = -side
            stop = min(-best, near_(older), near_(bar))
            best, share = far(bar), step
        out = stop if signed else stop * side
        if not turned and far(bar) > best:
            best, share = far(bar), min(share + step, most)
        stop = min(stop + share * (best - stop), near_(older), near_(bar))
        return (bar, side, stop, best, share), (*row, out)

    return fold_ordered(df, list(SERIES), fold, f"{df.schema.toDDL()}, {name} double")


def with_ultosc(df: DataFrame, h: str, lo: str, c: str, periods: tuple[int, int, int], name: str = "ultosc") -> DataFrame:
    """Buying pressure by true range over three periods, the shorter weighing 4 and 2; null until the longest is full, the first row has neither."""
    prev = F.lag(c).over(ordered())
    pressure = F.when(prev.isNotNull(), F.col(c) - F.least(F.col(lo), prev))
    x = df.withColumns({"__bp": pressure, "__tr": F.when(prev.isNotNull(), true_range(h, lo, c))})
    part = lambda n: F.sum("__bp").over(trailing(n)) / F.nullif(F.sum("__tr").over(trailing(n)), F.lit(0.0))
    value = 100 * (4 * part(periods[0]) + 2 * part(periods[1]) + part(periods[2])) / 7
    return x.withColumn(name, F.when(F.count("__bp").over(trailing(periods[2])) == periods[2], value)).drop("__bp", "__tr")
