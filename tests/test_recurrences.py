"""Recurrences in many blocks against one block, and against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import indicators as ta
from tickloom.operators import recurrences

AT = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rng, out = random.Random(7), []
    for symbol, hours in (("A", 300), ("B", 20)):
        x = 100.0
        for i in range(hours * 4):
            x += rng.choice([-1.0, 1.0, 0.0, 0.25])
            reach = rng.random()
            out.append(("X", symbol, AT + dt.timedelta(minutes=15 * i), i, x + reach, x - reach, x, None if i % 17 == 3 else x, rng.randint(0, 9)))
    return spark.createDataFrame(out, "exchange string, symbol string, ts timestamp, seq long, h double, l double, c double, holes double, v int")


CASES = {
    "mean": lambda d, n: ta.with_mean(d, "c", 14, "x", n),
    "mean of holes": lambda d, n: ta.with_mean(d, "holes", 14, "x", n),
    "family": lambda d, n: ta.with_ema_family(d, "c", 5, n),
    "macd": lambda d, n: ta.with_macd(d, "c", 12, 26, 9, n),
    "macdfix": lambda d, n: ta.with_macdfix(d, "c", 9, n),
    "kama": lambda d, n: ta.with_kama(d, "c", 10, rows=n),
    "rsi": lambda d, n: ta.with_rsi(d, "c", 14, n),
    "atr": lambda d, n: ta.with_atr(d, "h", "l", "c", 14, n),
    "adosc": lambda d, n: ta.with_adosc(d, "h", "l", "c", "v", 3, 10, n),
    "deviation": lambda d, n: ta.with_ewm_std(d, "holes", 10, "x", n),
    "directional": lambda d, n: ta.with_directional(d, "h", "l", "c", 14, n),
}


@pytest.mark.parametrize("name", CASES)
def test_blocks_change_nothing(spark, bars, name):
    made = lambda n: CASES[name](bars, n).toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True)
    whole, parts = made(0), made(40)
    assert list(whole.columns) == list(parts.columns) and len(whole) == bars.count()
    for c in set(whole.columns) - set(bars.columns):
        a, b = whole[c].to_numpy(dtype=float), parts[c].to_numpy(dtype=float)
        assert abs(a - b)[~(a != a)].max() < 1e-8 and ((a != a) == (b != b)).all() and (a == a).sum() > 100


def test_means_equal_a_loop(bars):
    rows = bars.where("symbol = 'A'").orderBy("seq").collect()
    got = {r["seq"]: r["x"] for r in ta.with_mean(bars.where("symbol = 'A'"), "holes", 14, "x", 40).collect()}
    seen, y = [], None
    for r in rows:
        if r["holes"] is None:
            assert got[r["seq"]] is None
            continue
        seen.append(r["holes"])
        y = sum(seen) / 14 if len(seen) == 14 else None if y is None else y + (r["holes"] - y) * 2 / 15
        assert (got[r["seq"]] is None) == (y is None) and (y is None or abs(got[r["seq"]] - y) < 1e-9)


def test_fixed_and_simple_means(bars):
    rows = [r["c"] for r in bars.where("symbol = 'B'").orderBy("seq").collect()]
    fix = [r["macdfix"] for r in ta.with_macdfix(bars.where("symbol = 'B'"), "c").orderBy("seq").collect()]
    quick, slow = sum(rows[14:26]) / 12, sum(rows[:26]) / 26
    assert fix[24] is None and abs(fix[25] - (quick - slow)) < 1e-9
    for i in range(26, len(rows)):
        quick, slow = 0.85 * quick + 0.15 * rows[i], 0.925 * slow + 0.075 * rows[i]
        assert abs(fix[i] - (quick - slow)) < 1e-9
    ext = ta.with_macdext(bars.where("symbol = 'B'"), "c", 3, 5, 4).orderBy("seq").collect()
    lines = [None if i < 4 else sum(rows[i - 2 : i + 1]) / 3 - sum(rows[i - 4 : i + 1]) / 5 for i in range(len(rows))]
    for i, r in enumerate(ext):
        assert (r["macdext"] is None) == (i < 4) and (r["macdext_signal"] is None) == (i < 7)
        if i >= 7:
            assert abs(r["macdext"] - lines[i]) < 1e-9 and abs(r["macdext_signal"] - sum(lines[i - 3 : i + 1]) / 4) < 1e-9


def test_scan_equals_a_loop():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b, y = rng.random(100), rng.random(100), 3.0
    got = recurrences.scan(a, b, y)
    for i in range(100):
        y = a[i] * y + b[i]
        assert abs(got[i] - y) < 1e-12
    assert len(recurrences.scan(0.5, b[:0], 1.0)) == 0


def test_empty(bars):
    assert ta.with_rsi(bars.where("false"), "c", 14).isEmpty() and ta.with_mean(bars.where(F.lit(False)), "c", 3, "x").isEmpty()
