"""Labels and rewards of blocks against plain loops, whatever the blocks."""

import datetime as dt
import random
import time

import numpy as np
import pytest

from tickloom.operators import evaluation, labels, searches

AT = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def ticks(spark):
    rng, out = random.Random(5), []
    for symbol, n in (("A", 1500), ("B", 7)):
        x = 100.0
        for i in range(n):
            x = max(50.0, x + rng.choice([-1.0, 1.0, 0.0, 5.0, -5.0]))
            out.append(("X", symbol, AT + dt.timedelta(minutes=3 * i), i, None if i % 41 == 5 else x, 0.01 * rng.randint(0, 6), x + 0.5))
    return spark.createDataFrame(out, "exchange string, symbol string, ts timestamp, seq long, p double, v double, k double")


@pytest.mark.parametrize("rows", [0, 50])
@pytest.mark.parametrize("n", [1, 10, 100])
def test_barriers_equal_a_loop(ticks, n, rows):
    got = {(r["symbol"], r["seq"]): r["label"] for r in labels.triple_barrier(ticks, "p", "v", n, 1.5, 1.0, rows=rows).collect()}
    want = {}
    for symbol in "AB":
        own = ticks.where(f"symbol = '{symbol}'").orderBy("seq").collect()
        for i in range(len(own) - n):
            first = []
            for test in (lambda r, v: r >= 1 + v * 1.5, lambda r, v: r <= 1 - v * 1.0, lambda r, v: r <= 1 - v * 1.5, lambda r, v: r >= 1 + v * 1.0):
                later = [j for j in range(i + 1, i + n + 1) if own[i]["p"] is not None and own[j]["p"] is not None and test(own[j]["p"] / own[i]["p"], own[j]["v"])]
                first.append(later[0] if later else i + n + 1)
            lt, ls, st, ss = first
            want[(symbol, own[i]["seq"])] = -1 if st < ss and st < lt else 1 if lt < ls and lt < st else 0
    assert got == want


@pytest.mark.parametrize("rows", [0, 50])
@pytest.mark.parametrize("decay", [0.3, 0.9, 0.995])
def test_rewards_equal_a_loop(ticks, decay, rows):
    n = evaluation.horizon(decay, 0.05)
    got = {(r["symbol"], r["seq"]): r["reward"] for r in evaluation.with_discounted_reward(ticks, "p", "k", decay, 0.05, rows=rows).collect()}
    for symbol in "AB":
        own = ticks.where(f"symbol = '{symbol}'").orderBy("seq").collect()
        for i, r in enumerate(own):
            value = got[(symbol, r["seq"])]
            if r["p"] is None:
                assert value is None
                continue
            want = sum(decay**j * (x["p"] - r["k"]) / r["p"] for j, x in enumerate(own[i : i + n]) if x["p"] is not None) * 1e6 / n
            assert abs(value - want) < 1e-6 * max(1, abs(want))


def test_a_search_skips_what_rounding_finds():
    tops = searches.Tops(np.array([1.0, 3.0, np.nan, 2.0, 5.0]))
    assert tops.first(np.arange(5), np.full(5, 2.0)).tolist() == [1, 1, 3, 3, 4]
    assert tops.first(np.array([0]), np.array([9.0])).tolist() == [5] and searches.Tops(np.zeros(0)).first(np.array([0]), np.array([1.0])).tolist() == [0]
    odd = searches.first_where(tops, np.zeros(2, int), np.array([2.0, 2.0]), np.array([5, 3]), lambda i, j: j >= 3)
    assert odd.tolist() == [3, 3]


def test_long_horizons_cost_no_more():
    rng, took = np.random.default_rng(1), {}
    p, v = np.cumsum(rng.normal(size=60_000)) + 1000, np.full(60_000, 0.01)
    for n in (4, 4096):
        began = time.time()
        for _ in range(3):
            searches.Tops(p / (1 + v)).first(np.arange(60_000) + 1, p)
        took[n] = time.time() - began
    assert took[4096] < 5 * took[4] + 0.5
