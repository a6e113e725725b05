"""Curves, peaks and dips of deals found in blocks against the same over a row for each row held."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_held import BY, tables

from tickloom.operators import exits, held
from tickloom.plans import catalog

SF = "/root/testdata/sf0.001"


def both(spark, seed=3):
    curve, entries = tables(spark, seed, 300)
    entries = entries.unionByName(entries.select(F.concat("id", F.lit("long")).alias("id"), *BY, "ts", (F.col("end") + F.expr("INTERVAL 15 HOUR")).alias("end"), "p0", "direction"))
    return curve, entries, exits.deal_curves(exits.held_rows(entries, curve, BY))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("size", [0, 1, 60])
def test_curves_equal_windows_over_held_rows(spark, size, monkeypatch):
    curve, entries, c = both(spark)
    w = Window.partitionBy("id").orderBy("ts", "seq")
    c = c.withColumn("gain", F.col("profit") - F.coalesce(F.lag("profit").over(w), F.lit(0.0)))
    c = c.withColumn("final", F.max_by("profit", F.struct("ts", "seq")).over(Window.partitionBy("id")))
    names = ["id", "ts", "seq", "size", *held.CURVES]
    got = held.curves_in_blocks(entries, curve, BY, ["ts", "seq", "size"], list(held.CURVES), rows=size)
    assert got.columns == names and got.count() > 1000
    assert rows(got, *names) == rows(c, *names)


@pytest.mark.parametrize("size", [0, 1])
def test_peaks_equal_those_of_held_rows(spark, size):
    curve, entries, c = both(spark)
    for distance in (1, 3, 9):
        want = rows(exits.peaks(c, "profit", 1.0, distance, 2.0), "id", "ts", "seq", "profit", "prominence")
        assert len(want) > 50
        assert rows(held.peaks_in_blocks(entries, curve, BY, 1.0, distance, 2.0, rows=size), "id", "ts", "seq", "profit", "prominence") == want


@pytest.mark.parametrize("size", [0, 60])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_twin_peaks_equal_those_of_held_rows(spark, size, n):
    curve, entries, c = both(spark)
    want = rows(exits.twin_peaks(c, n, 0.02), "id", "exit_ts", "exit_seq")
    assert sum(r[1] is not None for r in want) > 10
    assert rows(held.twin_peaks_in_blocks(entries, curve, BY, n, 0.02, rows=size), "id", "exit_ts", "exit_seq") == want


@pytest.mark.parametrize("size", [0, 60])
def test_dips_equal_those_of_held_rows(spark, size):
    curve, entries, _ = both(spark)
    curve = curve.where("price IS NOT NULL")
    c = exits.held_rows(entries, curve, BY)
    names = ["id", "dip_ix", "back_ix", "least_ix", "least_ts"]
    want = rows(exits.dip_and_return(c, F.col("price"), F.lit(98.0), 2), *names)
    assert sum(r[4] is not None for r in want) > 10
    assert rows(held.dips_in_blocks(entries, curve, BY, 98.0, 2, rows=size), *names) == want


@pytest.mark.parametrize("name", ["x02_deal_curves", "x20_tick_profit", "j19_deal_features", "x06_twin_peaks", "x07_peaks", "x08_dip_and_return"])
def test_rows_held_are_not_shuffled(spark, name):
    """Deals and ticks meet in blocks; nothing is sorted, grouped or joined after that."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("FlatMapGroupsInArrow")[0]
    assert "FlatMapGroupsInArrow" in plan and not any(x in above for x in ("Window", "Exchange", "Join", "Aggregate"))
