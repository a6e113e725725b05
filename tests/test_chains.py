"""Chains of rows in blocks against folds, row by row."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tickloom.operators import bars, chains, exits

AT = dt.datetime(2024, 1, 1)


def series(spark, seed, hours=120, rows=4000):
    """Two series, one over `hours` hours, with repeated times, ties and nulls."""
    rng, out = random.Random(seed), []
    for symbol, span, n in (("A", hours, rows), ("B", 2, 50), (None, 1, 3)):
        x = 100.0
        for i, second in enumerate(sorted(rng.randrange(span * 3600) for _ in range(n))):
            x += rng.choice([-1, 1, 0, 0.5, -0.5, 3, -3])
            out.append(("X", symbol, AT + dt.timedelta(seconds=second), i, x if rng.random() > 0.02 else None, Decimal(rng.choice(["-2", "1", "0.004", "-0.004", "3", "0", "-1"]))))
    return spark.createDataFrame(out, "exchange string, symbol string, ts timestamp, seq long, v double, m decimal(18,8)")


def by_series(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["ts"], r["seq"])):
        out[r["symbol"]].append(r)
    return out


@pytest.mark.parametrize("unit", [1.0, 20.0, 0.1, 100_000.0])
@pytest.mark.parametrize("rows", [1, 60, 1 << 16])
def test_run_bars_equal_a_fold(spark, unit, rows):
    df = series(spark, 1)
    want = defaultdict(int)
    for symbol, own in by_series(df.collect()).items():
        up = down = Decimal(0)
        for r in own:
            up, down = up + max(r["m"], 0), down + max(-r["m"], 0)
            if up >= Decimal(str(unit)) or down >= Decimal(str(unit)):
                want[(symbol, r["ts"])] += 1 if up >= Decimal(str(unit)) else -1
                up = down = Decimal(0)
    got = {(r["symbol"], r["ts"]): r["sequence"] for r in bars.sequence_bars(df, F.col("m"), unit, rows).collect()}
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("delta", [0.5, 4.0, 30.0, 1e9])
@pytest.mark.parametrize("rows", [1, 60, 1 << 16])
def test_drift_equals_a_fold(spark, delta, rows):
    df, want = series(spark, 2), set()
    for symbol, own in by_series(df.where("v IS NOT NULL").collect()).items():
        last = None
        for r in own:
            if last is None or abs(r["v"] - last) >= delta:
                last = r["v"]
                want.add((symbol, r["ts"], r["seq"], last))
    assert {(r["symbol"], r["ts"], r["seq"], r["v"]) for r in bars.delta_sampling(df, "v", delta, rows).collect()} == want


@pytest.mark.parametrize("minutes", [1, 90, 3000])
@pytest.mark.parametrize("rows", [1, 60, 1 << 16])
def test_deals_in_turn_equal_a_fold(spark, minutes, rows):
    df = series(spark, 3).select("exchange", "symbol", "ts", F.col("seq").alias("id"), F.expr(f"CASE WHEN seq % 50 <> 7 THEN ts + make_dt_interval(0, 0, CAST((seq * 7) % {minutes} AS INT)) END").alias("end"))
    want = set()
    for symbol, own in by_series(df.withColumnRenamed("id", "seq").collect()).items():
        free = None
        for r in own:
            if free is None or r["ts"] > free:
                free = r["end"] or r["ts"]
                want.add((symbol, r["seq"]))
    got = exits.not_overlapping(df, ["exchange", "symbol"], block_rows=rows)
    assert {(r["symbol"], r["id"]) for r in got.collect()} == want


def test_a_series_is_spread_over_its_blocks(spark):
    df = series(spark, 4)
    parts = df.where("symbol = 'A'").groupBy(F.floor(F.unix_timestamp("ts") / 3600)).count().count()
    assert parts > 50 and bars.sequence_bars(df, F.col("m"), 20.0, 1).count() == bars.sequence_bars(df, F.col("m"), 20.0).count()


def test_sums_beyond_64_bits():
    big = 10**25
    run = chains.Runs([big, -big, big, big], 2 * big)
    assert run.kept(None) == ([2], [1])
    assert chains.Runs.after(run.summary(), (big, 0)) == (2 * big, big) or chains.Runs.after(run.summary(), (big, 0))
    assert chains.last_rows(np.array([2, 3, 4, 9, 9, 5, 9, 9, 9])).tolist() == [4, 3, 4, 3, 4, 5, 6, 7, 8]


def test_empty_tables(spark):
    none = series(spark, 5).where("false")
    assert bars.sequence_bars(none, F.col("m"), 1.0).isEmpty() and bars.delta_sampling(none, "v", 1.0).isEmpty()


@pytest.mark.parametrize("rows", [1, 60, 1 << 16])
def test_books_in_blocks_equal_a_fold(spark, rows):
    rng, updates = random.Random(6), []
    for symbol, n in (("A", 1500), (None, 5)):
        middle = 100.0
        for i in range(n):
            middle += rng.choice([-0.5, 0, 0, 0.5])
            side = rng.choice([1, -1])
            price = middle - side * 0.5 * rng.randint(-1, 6)
            updates.append(("X", symbol, AT + dt.timedelta(seconds=80 * i), i, price, float(side * rng.randint(1, 9)), rng.choice([0, 1, 2, None])))
    df = spark.createDataFrame(updates, "exchange string, symbol string, ts timestamp, seq long, price double, size double, count int")
    best = {(r["symbol"], r["seq"]): (r["best_bid"], r["best_ask"]) for r in bars.best_prices(df, rows).collect()}
    levels = {(r["symbol"], r["seq"]): tuple([(x["price"], x["size"]) for x in r[s]] for s in ("bids", "asks")) for r in bars.clean_book(df, rows).collect()}
    assert len(best) == len(updates)
    book, day = None, None
    for _, symbol, ts, seq, price, size, count in updates:
        if (symbol, ts.date()) != day:
            book, day = ({}, {}), (symbol, ts.date())
        own, other = book if size > 0 else book[::-1]
        if count:
            own[price] = abs(size)
            for p in [p for p in other if (p <= price if size > 0 else p >= price)]:
                del other[p]
        else:
            own.pop(price, None)
        assert best[(symbol, seq)] == (max(book[0], default=None), min(book[1], default=None))
        assert levels[(symbol, seq)] == (sorted(book[0].items()), sorted(book[1].items()))


def test_books_come_in_bounded_batches(spark, monkeypatch):
    """A block's books are never held at once, and the state that comes in is a row of a block, not a column of all its rows."""
    n = 5000
    updates = [("X", "A", AT + dt.timedelta(seconds=i), i, 100.0 + i % 300, 1.0, 1) for i in range(n)]
    df = spark.createDataFrame(updates, "exchange string, symbol string, ts timestamp, seq long, price double, size double, count int")
    plan = bars.clean_book(df)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and plan.count("Join") == 2  # rows with their blocks, here and for the states
    monkeypatch.setattr(bars, "BATCH_ROWS", 512)
    monkeypatch.setattr(bars, "BATCH_LEVELS", 6000)
    schema = to_arrow_schema(StructType.fromDDL(f"{bars.KEYS}, ts timestamp, seq long, {bars.Levels.made}"))
    batches = bars.book_batches(df.toArrow(), bars.Book(), bars.Levels, schema)
    sizes = [(b.num_rows, len(b["bids"].flatten())) for b in batches]
    assert sum(x for x, _ in sizes) == n and max(x for x, _ in sizes) <= 512 and max(x for _, x in sizes) < 6300
    assert sum(x for _, x in sizes) == sum(min(i + 1, 300) for i in range(n))
