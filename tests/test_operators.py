"""Hand cases: order, first row, signed floors, resets, ties, chunked against unchunked."""

import datetime as dt
import gzip

from pyspark.sql import functions as F

from tickloom.functions import scalars
from tickloom.operators import bars, labels, store, windows
from tickloom.sources import ticks as sources
from tickloom.streaming import bars as stream

T0 = dt.datetime(2024, 1, 1)


def frame(spark, values, name="m", step=60):
    rows = [("X", "A", T0 + dt.timedelta(seconds=step * i), i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"exchange string, symbol string, ts timestamp, seq long, {name} double")


def test_first_tick_never_emits_and_floor_is_signed(spark):
    got = bars.unit_bars(frame(spark, [12, 1, -14, 16]), F.col("m"), 5).orderBy("ts").collect()
    assert [r["volume_size"] for r in got] == [-3, 4]


def test_sequence_bars_restart_both_sides(spark):
    got = bars.sequence_bars(frame(spark, [3, -4, 3, -4, 5]), F.col("m"), 5).orderBy("ts").collect()
    assert [r["sequence"] for r in got] == [1, 1]


def test_delta_sampling_rebases_to_the_value(spark):
    got = bars.delta_sampling(frame(spark, [0, 1, 2.5, 3, 4.4, 4.6]), "m", 2.0).orderBy("ts").collect()
    assert [r["m"] for r in got] == [0, 2.5, 4.6]


def test_chunked_sum_and_scan_equal_plain_ones(spark):
    values = [((i * 37) % 11) - 5 for i in range(200)]
    df = frame(spark, values, step=1800)
    got = [r["s"] for r in windows.cumsum_chunked(df, F.col("m"), "s").orderBy("seq").collect()]
    assert got == [sum(values[: i + 1]) for i in range(200)]
    y, want = 0.0, []
    for v in values:
        y = 0.9 * y + v
        want.append(y)
    got = [r["y"] for r in windows.linear_scan(df, 0.9, F.col("m"), "y").orderBy("seq").collect()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_barriers_by_hand(spark):
    df = frame(spark, [100, 100, 130, 70], "p").withColumn("v", F.lit(0.1))
    got = {r["seq"]: r["label"] for r in labels.triple_barrier(df, "p", "v", 2, 2.0, 2.0).collect()}
    assert got == {0: 1, 1: 1}  # the long target comes first
    wide = frame(spark, [100, 100, 100], "p").withColumn("v", F.when(F.col("seq") > 0, -0.1).otherwise(0.1))
    got = {r["seq"]: r["label"] for r in labels.triple_barrier(wide, "p", "v", 1, 2.0, 2.0).collect()}
    assert got == {0: 0, 1: 0}  # both sides are touched on one row


def test_precision_and_scale_by_hand(spark):
    values = {236.57: (5, 2), 100.0: (3, 0), 0.05: (3, 2), 0.0: (1, 0), 0.1 + 0.2: (2, 1), -12.5: (3, 1), 123456789012345.6: (15, 0), 1e-6: (7, 6)}
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = {r["x"]: (r["p"], r["s"]) for r in df.select("x", *[c.alias(n) for c, n in zip(scalars.precision_and_scale("x"), "ps")]).collect()}
    assert got == values


def test_purge_counts(spark):
    got = labels.purged_folds(frame(spark, range(10)), 5, 2).where("fold = 2 AND role = 'train'")
    assert sorted(r["ix"] for r in got.collect()) == [0, 8, 9]


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "series")
    rows = frame(spark, range(5)).withColumn("day", F.to_date("ts").cast("string"))
    for _ in range(2):
        store.write_upsert(rows, path, ["exchange", "symbol", "ts"], "day")
    store.write_upsert(rows.where("seq = 3").withColumn("m", F.lit(9.0)), path, ["exchange", "symbol", "ts"], "day")
    got = spark.read.parquet(path)
    assert got.count() == 5 and got.where("seq = 3").first()["m"] == 9.0


def test_trades_reader_drops_corrupt_rows(spark, tmp_path):
    with gzip.open(tmp_path / "20240102_deal.csv.gz", "wt") as f:
        f.write("1.2345,100.5,-2,Sell\nbad,1,1,Buy\n2.0,101,3,Buy\n12345678901.0,1,1,Buy\n")
    got = sources.trades(spark, str(tmp_path / "*_deal*"), "A", "2024-01-01", "2024-01-02").orderBy("seq").collect()
    assert [(r["side"], float(r["size"])) for r in got] == [(-1, 2.0), (1, 3.0)]
    assert got[0]["ts"] == dt.datetime(2024, 1, 2, 0, 0, 1, 234000)
    assert sources.trades(spark, str(tmp_path / "*_deal*"), "A", "2025-01-01", "2025-01-02").isEmpty()


def test_streaming_unit_bars_equal_batch(spark, tmp_path):
    df = frame(spark, [((i * 7) % 9) - 3 for i in range(50)])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.unit_bars(source, "m", 5).writeStream.format("memory").queryName("unit_bars").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("unit_bars").collect())
    assert got == sorted(tuple(r) for r in bars.unit_bars(df, F.col("m"), 5).collect())


def test_intervals_with_the_same_end_give_the_first_one(spark):
    from tickloom.operators import joins

    t = [dt.datetime(2024, 1, 1, 0, i) for i in range(4)]
    ends = spark.createDataFrame([("X", "a", t[2], k) for k in (9, 7, 8)] + [("X", "a", t[0], 5)], "exchange string, symbol string, ts timestamp, k long")
    rows = spark.createDataFrame([("X", "a", at, i) for i, at in enumerate(t)], "exchange string, symbol string, ts timestamp, seq long")
    got = joins.interval_bin(rows, ends.repartition(3), ["exchange", "symbol"], "k").orderBy("seq").collect()
    assert [(r["seq"], r["k"]) for r in got] == [(0, 5), (1, 7), (2, 7)]
