"""Peaks against a plain search, executions, trades in turn."""

import datetime as dt

from pyspark.sql import functions as F

from tickloom.operators import exits, selection

T0 = dt.datetime(2024, 1, 1)


def held(spark, values, id_=1):
    rows = [(id_, T0 + dt.timedelta(minutes=i), i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, ts timestamp, seq long, v double")


def plain_peaks(x, height, distance, prominence):
    at = [i for i in range(1, len(x) - 1) if x[i - 1] < x[i] > x[i + 1] and x[i] >= height]
    kept = []
    for i in sorted(at, key=lambda i: (x[i], i), reverse=True):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    out = []
    for i in sorted(kept):
        a = i
        while a > 0 and x[a - 1] <= x[i]:
            a -= 1
        z = i
        while z < len(x) - 1 and x[z + 1] <= x[i]:
            z += 1
        if x[i] - max(min(x[a : i + 1]), min(x[i : z + 1])) >= prominence:
            out.append(i)
    return out


def test_peaks_equal_a_plain_search(spark):
    series = {1: [(i * 37 + i * i) % 23 for i in range(120)], 2: [5, 9, 5, 9, 4], 3: [1, 2], 4: [3, 3, 3, 3]}
    df = None
    for k, v in series.items():
        df = held(spark, v, k) if df is None else df.unionByName(held(spark, v, k))
    found = exits.peaks(df, "v", 6.0, 4, 3.0).collect()
    got = {k: sorted(r["seq"] for r in found if r["id"] == k) for k in series}
    assert got == {k: plain_peaks(v, 6.0, 4, 3.0) for k, v in series.items()}
    assert exits.peaks(df.limit(0), "v", 6.0, 4, 3.0).isEmpty()


def test_twin_peaks_and_missing_exit(spark):
    df = held(spark, [1, 1, 9, 9, 2, 2, 7, 7, 1, 1, 0, 0], 1).unionByName(held(spark, [1, 2, 3, 4, 5, 6], 2))
    rows = exits.deal_curves(df.withColumns({"price": F.col("v") + 100, "p0": F.lit(100.0), "direction": F.lit(1), "entry_ts": F.lit(T0)}))
    got = {r["id"]: r["exit_seq"] for r in exits.twin_peaks(rows, 2, 0.01).collect()}
    assert got == {1: 10, 2: None}


def test_reversals_take_the_quantity_before(spark):
    rows = [(1, 1, "Buy", "P", "Deal", 10.0), (1, 2, "Sell", "P", "Deal", 3.0), (1, 3, "Sell", None, "Deal", 4.0), (1, 4, "Buy", None, "Deal", 5.0), (1, 5, "Sell", "P", "Deal", 6.0), (1, 6, "Sell", None, "Funding", 7.0)]
    df = spark.createDataFrame(rows, "k int, n int, side string, exec_inst string, text string, quantity double").withColumns({"price": F.lit(2.0), "commission": F.lit(0.5)})
    got = [(r["n"], r["timing"], r["direction"], r["quantity"]) for r in exits.orders_of_executions(df, "k", ["n"], "P").orderBy("n").collect()]
    assert got == [(1, "entry", 1, 10.0), (2, "exit", -1, -10.0), (3, "exit", -1, -4.0)]


def test_trades_in_turn(spark):
    rows = [("a", i, T0 + dt.timedelta(minutes=s), T0 + dt.timedelta(minutes=e)) for i, (s, e) in enumerate([(0, 10), (5, 7), (10, 12), (11, 30), (20, 21), (31, 32)])]
    df = spark.createDataFrame(rows, "strategy string, id long, ts timestamp, end timestamp")
    assert sorted(r["id"] for r in exits.not_overlapping(df, ["strategy"]).collect()) == [0, 3, 5]
    assert sorted(r["id"] for r in exits.not_overlapping(df, ["strategy"], F.lit(T0 + dt.timedelta(minutes=1))).collect()) == [1, 2, 4, 5]


def test_chunk_order_of_25_rows_is_the_transposed_square(spark):
    rows = spark.createDataFrame([("X", "a", i) for i in range(25)], "exchange string, symbol string, seq long").withColumn("ts", F.lit(T0))
    got = [r["ix"] for r in selection.chunk_order(rows, 5).orderBy("new_ix").collect()]
    assert got == [5 * (i % 5) + i // 5 for i in range(25)]


def test_summaries_of_a_line(spark):
    rows = spark.createDataFrame([("X", "a", i, None if i < 2 else float(i)) for i in range(6)], "exchange string, symbol string, i int, p double")
    got = selection.summaries(rows, "p", ["exchange", "symbol"], ["i"]).first()
    assert (got["n"], got["leading_nulls"], round(got["r2"], 9), got["return"], got["sortino"]) == (4, 2, 1.0, 1.5, None)
