"""Frames of any length, percentiles and spines against plain loops."""

import datetime as dt
import random
import time

import numpy as np
import pytest

from tickloom.operators import bars, selection, windows

AT = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 64, 1000])
def test_frames_equal_a_loop(n):
    rng = np.random.default_rng(n)
    x = 1e6 + rng.normal(size=400)
    x[rng.random(400) < 0.1] = np.nan
    f = windows.frames(x, n)
    for i in range(400):
        own = x[max(0, i - n + 1) : i + 1]
        own = own[~np.isnan(own)]
        assert f["count"][i] == len(own)
        if len(own):
            want = (own.sum(), own.mean(), ((own - own.mean()) ** 2).sum(), own.max(), own.min())
            assert np.allclose([f[k][i] for k in ("sum", "mean", "dev", "max", "min")], want, rtol=1e-9, atol=1e-6)


def test_long_frames_cost_no_more():
    x, took = np.random.default_rng(1).normal(size=100_000), {}
    for n in (16, 3600):
        windows.frames(x, n)
        began = time.time()
        for _ in range(3):
            windows.frames(x, n)
        took[n] = time.time() - began
    assert took[3600] < 6 * took[16] + 0.5


@pytest.fixture(scope="module")
def ticks(spark):
    rng, out = random.Random(9), []
    for symbol, n in (("A", 900), (None, 30)):
        for i in range(n):
            out.append(("X", symbol, AT + dt.timedelta(minutes=2 * i), i, None if i % 37 == 1 else rng.choice([1.0, 2.5, 100.0]) * rng.random() + 50))
    return spark.createDataFrame(out, "exchange string, symbol string, ts timestamp, seq long, v double")


@pytest.mark.parametrize("rows", [0, 40])
def test_rolling_and_scores_in_blocks(ticks, rows):
    made = windows.with_rolling(ticks, {"c": ("count", "v", 45), "s": ("sum", "v", 45), "m": ("max", "v", 7)}, rows=rows)
    full = windows.with_rolling(ticks, {"a": ("mean", "v", 45)}, full_only=True, rows=rows)
    score = windows.with_zscore(ticks, "v", 45, rows=rows)
    ahead = windows.with_touches_ahead(ticks, "v", 20, 5.0, "t", rows=rows)
    for symbol in ("A", None):
        own = lambda df: [r for r in sorted(df.collect(), key=lambda r: r["seq"]) if r["symbol"] == symbol]
        v = np.array([np.nan if r["v"] is None else r["v"] for r in own(ticks)])
        for i, (r, a, z, t) in enumerate(zip(own(made), own(full), own(score), own(ahead))):
            w = v[max(0, i - 44) : i + 1]
            w = w[~np.isnan(w)]
            assert r["c"] == len(w) and abs((r["s"] or 0) - w.sum()) < 1e-6
            assert (a["a"] is None) == (len(w) < 45)
            if len(w) < 45:
                assert z["z"] == 0
            elif not np.isnan(v[i]):
                assert abs(z["z"] - (v[i] - w.mean()) / w.std()) < 1e-6
            later = v[i + 1 : i + 21]
            assert t["t"] == int(bool((later[~np.isnan(later)] >= v[i] + 5).any()))


@pytest.mark.parametrize("ranges", [4, 4096])
def test_percentiles_are_exact(spark, ranges):
    rng, rows = random.Random(3), []
    for k, n, draw in ((1, 3000, lambda: rng.gauss(0, 1)), (2, 500, lambda: rng.choice([1.0, 2.0])), (3, 400, lambda: 10 ** rng.uniform(-9, 9)), (4, 1, lambda: 7.0), (None, 50, lambda: rng.random()), (5, 3, lambda: None)):
        rows += [(k, draw()) for _ in range(n)]
    rows += [(1, None)] * 5
    df, shares = spark.createDataFrame(rows, "k int, v double"), [0.0, 0.01, 0.5, 0.9, 0.995, 1.0]
    got = {r["k"]: r["q"] for r in selection.percentiles(df, ["k"], "v", shares, ranges).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for k, q in got.items():
        own = np.array([v for g, v in rows if g == k and v is not None])
        assert np.allclose(q, np.quantile(own, shares), rtol=1e-12)
    whole = selection.percentiles(df, [], "v", [0.25], ranges).collect()
    assert np.isclose(whole[0]["q"][0], np.quantile([v for _, v in rows if v is not None], 0.25))
    assert selection.percentiles(df.where("false"), ["k"], "v", [0.5]).isEmpty()


def test_a_spine_of_seconds(spark):
    ends = spark.createDataFrame([("X", "A", AT, AT + dt.timedelta(days=3, seconds=5)), ("X", "B", AT, AT)], "exchange string, symbol string, a timestamp, b timestamp")
    rows = windows.spine(ends, "1 second")
    assert rows.where("symbol = 'A'").count() == 3 * 86_400 + 6 == rows.where("symbol = 'A'").distinct().count()
    assert rows.where("symbol = 'B'").count() == 1 and rows.agg({"ts": "max"}).first()[0] == AT + dt.timedelta(days=3, seconds=5)
    assert windows.spine(ends, "36 hours").where("symbol = 'A'").count() == 3


def test_last_values_of_a_spine(spark):
    ticks = spark.createDataFrame([("X", "A", AT, 1, 5.0, 1.0), ("X", "A", AT + dt.timedelta(days=2), 2, 6.0, 1.0)], "exchange string, symbol string, ts timestamp, seq long, price double, size double")
    got = bars.last_filled(ticks, "1 hour", "price").orderBy("ts").collect()
    assert [r["price"] for r in got] == [5.0] * 48 + [6.0]
