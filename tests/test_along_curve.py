"""Rows held come along the curve, in bounded batches, so what the rows of one curve row share is written once."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import exits, held
from tickloom.plans import catalog

AT = dt.datetime(2024, 1, 1)
BY = ["exchange", "symbol"]


def tables(spark, prices, every=2, minutes=600):
    curve = [("X", "A", AT + dt.timedelta(seconds=20 * i), i, float(x)) for i, x in enumerate(prices)]
    entries = [(i, "X", "A", AT + dt.timedelta(seconds=20 * i), AT + dt.timedelta(seconds=20 * i, minutes=minutes), float(prices[i]), 1 if i % 3 else -1) for i in range(0, len(prices), every)]
    return (
        spark.createDataFrame(curve, "exchange string, symbol string, ts timestamp, seq long, price double"),
        spark.createDataFrame(entries, "id long, exchange string, symbol string, ts timestamp, end timestamp, p0 double, direction int"),
    )


def drawn(n):
    rng = random.Random(5)
    return [100 + rng.randint(0, 5000) / 100 for _ in range(n)]


def runs(values):
    return 1 + sum(a != b for a, b in zip(values, values[1:]))


def test_peaks_of_one_row_come_together(spark):
    curve, entries = tables(spark, drawn(1500))
    rows = held.peaks_in_blocks(entries, curve, BY, 5.0, 3, 10.0).select("seq").collect()
    assert len(rows) > 50_000
    assert runs([r["seq"] for r in rows]) <= 2 * 1500  # once a direction; once a row before


def test_curves_of_one_row_come_together(spark):
    curve, entries = tables(spark, drawn(1500))
    rows = held.curves_in_blocks(entries, curve, BY, ["ts", "seq"], ["gain"]).select("seq", "gain").collect()
    assert len(rows) > 500_000
    assert runs([r["seq"] for r in rows]) <= 1500
    assert runs([r["gain"] for r in rows]) < len(rows) / 50


def dense(spark, folder):
    """16 hours of one symbol, 24 days of it laid over one another."""
    e = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id % 5 = 0").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    day = F.floor(F.unix_micros("ts") / 86_400_000_000).cast("long")
    e = e.where(day < 19723 + 24).withColumn("ts", F.timestamp_micros(F.unix_micros("ts") - (day - 19723) * 86_400_000_000)).where("ts < TIMESTAMP'2024-01-01 16:00:00'")
    e.coalesce(1).write.parquet(f"{folder}/events.parquet")


@pytest.mark.parametrize("name, most", [("x07_peaks", 4.0), ("x20_tick_profit", 2.0)])
def test_dense_results_take_few_bytes(spark, name, most, tmp_path):
    """One symbol at 24 times its density: 5.1 and 3.6 bytes a row when rows came deal by deal."""
    dense(spark, f"{tmp_path}/in")
    out = catalog.queries()[name](spark, f"{tmp_path}/in")
    out.coalesce(1).write.parquet(f"{tmp_path}/out")
    size = sum(os.path.getsize(f"{tmp_path}/out/{f}") for f in os.listdir(f"{tmp_path}/out") if f.endswith(".parquet"))
    n = spark.read.parquet(f"{tmp_path}/out").count()
    assert n > 20_000 and size / n < most, (n, size / n)


@pytest.mark.parametrize("name", ["x02_deal_curves", "j19_deal_features"])
def test_rows_of_one_tick_come_together(spark, name, tmp_path):
    dense(spark, f"{tmp_path}/in")
    seq = [r["seq"] for r in catalog.queries()[name](spark, f"{tmp_path}/in").select("seq").collect()]
    assert len(seq) > 400_000
    assert runs(seq) < len(seq) / 10


def test_runs_that_deals_cut_are_those_of_held_rows(spark):
    """Every second row a peak: one run as long as the block, which each deal cuts at both ends."""
    curve, entries = tables(spark, zigzag(), 3, 30)
    c = exits.deal_curves(exits.held_rows(entries, curve, BY))
    names = ["id", "ts", "seq", "profit", "prominence"]
    for distance in (1, 3, 8):
        want = sorted(map(tuple, exits.peaks(c, "profit", 1.0, distance, 2.0).select(*names).collect()))
        assert len(want) > 300
        got = held.peaks_in_blocks(entries, curve, BY, 1.0, distance, 2.0)
        assert sorted(map(tuple, got.select(*names).collect())) == want


def zigzag():
    rng = random.Random(8)
    return [100 + (i % 2) * 20 + rng.randint(0, 900) / 100 for i in range(240)]


@pytest.mark.parametrize("cuts, batch", [(1, 1 << 16), (50, 7), (1 << 22, 1)])
def test_batches_do_not_change_peaks(cuts, batch, monkeypatch):
    """In this process, where the sizes of batches can be set."""
    x, first = np.array(zigzag()), np.arange(0, 240, 3) + 1
    stop, found = np.minimum(first + 90, 240), []
    for size in ({}, {"CUTS": cuts, "BATCH": batch}):
        for k, v in size.items():
            monkeypatch.setattr(held, k, v)
        made = [np.column_stack(b) for b in held.Peaks(x, 3).of(first, stop, x[first - 1], 1.0, 2.0)]
        assert not size or len(made) > 10
        found.append(sorted(map(tuple, np.concatenate(made).tolist())))
    assert found[0] == found[1] and len(found[0]) > 100


@pytest.mark.parametrize("batch", [1, 40, 1 << 16])
def test_batches_are_bounded_and_lose_no_row(batch, monkeypatch):
    monkeypatch.setattr(held, "BATCH", batch)
    rng = np.random.default_rng(3)
    first = rng.integers(0, 2000, 300)
    stop = np.minimum(first + rng.choice([1, 5, 700], 300), 2000)
    stop = np.maximum(stop, first + 1)
    count, last = np.zeros(300, int), 0
    for a, z, who in held.slabs(first, stop):
        assert last <= a < z and len(who) == len(set(who.tolist()))
        assert z - a == 1 or (z - a) * len(who) <= batch
        own = np.minimum(stop[who], z) - np.maximum(first[who], a)
        assert (own > 0).all()
        count[who] += own
        last = z
    assert (count == stop - first).all()


def test_curves_of_many_batches_equal_windows(spark):
    prices = drawn(1200)
    curve, entries = tables(spark, prices, 2, 100)
    curve = curve.withColumn("price", F.when(F.col("seq") % 53 != 9, F.col("price")))
    w = Window.partitionBy("id").orderBy("ts", "seq")
    c = exits.deal_curves(exits.held_rows(entries, curve, BY)).withColumn("gain", F.col("profit") - F.coalesce(F.lag("profit").over(w), F.lit(0.0)))
    c = c.withColumn("final", F.max_by("profit", F.struct("ts", "seq")).over(Window.partitionBy("id")))
    names = ["id", "seq", *held.CURVES]
    want, got = c.select(*names).persist(), held.curves_in_blocks(entries, curve, BY, ["seq"], list(held.CURVES)).select(*names).persist()
    assert want.count() == got.count() > 2 * held.BATCH
    assert want.exceptAll(got).isEmpty()
