"""Chunk-safe windows, exact bars and touches against plain versions, on two exchanges that share symbols."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import curves, scalars
from tickloom.operators import bars, book, joins, store, windows
from tickloom.streaming import bars as stream

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def ticks(spark):
    rng = random.Random(1)
    rows = []
    for x, s, n in (("X", "A", 500), ("Y", "A", 300), ("X", "B", 7)):
        at = T0
        for i in range(n):
            at += dt.timedelta(seconds=rng.choice([0, 1, 60, 4000, 90_000] if i % 50 == 0 else [0, 1, 30, 600]))
            rows.append((x, s, at, i, rng.choice([None, 1.0, 2.0, 5.0, 9.0, 14.0]), rng.choice([1, -1]), rng.choice([0.004, 1.5, 3.0])))
    return spark.createDataFrame(rows, "exchange string, symbol string, ts timestamp, seq long, v double, side int, size double").cache()


def by_series(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["ts"], r["seq"])):
        out.setdefault((r["exchange"], r["symbol"]), []).append(r)
    return out


def test_halos_equal_whole_series(ticks):
    def made(d, key):
        w = windows.trailing(20, key)
        return d.withColumns({"a": F.sum("v").over(w), "b": F.lag("v", 17).over(windows.ordered(key)), "c": F.max("v").over(windows.leading(9, key)), "d": F.count("v").over(w)})

    want = made(ticks, windows.SERIES)
    for rows in (0, 1, 8, 64):
        got = windows.near(ticks, made, 20, 8, rows=rows)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_block_is_not_a_series(ticks):
    plan = windows.block_plan(ticks, 5, 5, rows=32)
    own = plan.where("__own").groupBy("exchange", "symbol").agg(F.count_distinct("__block").alias("n"))
    assert {(r["exchange"], r["symbol"]): r["n"] > 3 for r in own.collect()} == {("X", "A"): True, ("Y", "A"): True, ("X", "B"): False}


def test_carried_values(ticks):
    got = by_series(windows.carried(ticks, {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")), "n": ("next", F.col("v"))}))
    for rows in got.values():
        values = [r["v"] for r in rows]
        for i, r in enumerate(rows):
            past, ahead = [x for x in values[: i + 1] if x is not None], [x for x in values[i:] if x is not None]
            want = (sum(past), max(past), past[-1]) if past else (None, None, None)
            assert (r["s"], r["m"], r["l"], r["n"]) == (*want, ahead[0] if ahead else None)


def test_upsampled_windows(ticks):
    got = by_series(windows.upsample(ticks, "v", [1, 4, 32, 256]))
    for rows in got.values():
        values = [r["v"] for r in rows]
        for i, r in enumerate(rows):
            for n in (1, 4, 32, 256):
                part = values[i + 1 - n : i + 1] if i + 1 >= n else []
                want = (sum(part), sum(part) / n, max(part), min(part)) if part else (None,) * 4
                assert tuple(r[f"v_{a}_{n}"] for a in ("sum", "avg", "max", "min")) == want
    with pytest.raises(ValueError):
        windows.upsample(ticks, "v", [3])


def test_first_touch_equals_a_search(ticks):
    rows = ticks.where("v IS NOT NULL")
    e = rows.select((F.hash("exchange", "symbol").cast("long") * 1000 + F.col("seq")).alias("id"), "exchange", "symbol", "ts", (F.col("ts") + F.expr("INTERVAL 3 HOUR")).alias("end"), (F.col("v") + 4 * F.col("side")).alias("level"), (F.col("side") > 0).alias("up"))
    want = {}
    curve = by_series(rows)
    for r in e.collect():
        hit = [c for c in curve[r["exchange"], r["symbol"]] if r["ts"] < c["ts"] <= r["end"] and (c["v"] >= r["level"] if r["up"] else c["v"] <= r["level"])]
        want[r["id"]] = (hit[0]["ts"], hit[0]["seq"]) if hit else (None, None)
    for size in (1 << 16, 40):
        old, windows.BLOCK_ROWS = windows.BLOCK_ROWS, size
        try:
            got = {r["id"]: (r["touch_ts"], r["touch_seq"]) for r in joins.first_touch(e, rows.select("exchange", "symbol", "ts", "seq", "v"), ["exchange", "symbol"], "v").collect()}
        finally:
            windows.BLOCK_ROWS = old
        assert got == want


def test_bars_of_small_sizes_and_two_exchanges(spark):
    rows = [(x, "A", T0 + dt.timedelta(seconds=i), i, 0.004) for x in "XY" for i in range(1000)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, ts timestamp, seq long, size double")
    for made in (bars.unit_bars(df, F.col("size"), 1), bars.unit_bars(df, F.col("size").cast("decimal(18,8)"), 1.0)):
        got = {x: [r["volume_size"] for r in made.where(F.col("exchange") == x).orderBy("ts").collect()] for x in "XY"}
        assert got == {"X": [1, 1, 1, 1], "Y": [1, 1, 1, 1]}
    exact = [r["n"] for r in spark.sql("SELECT CAST(x AS decimal(38,10)) AS x FROM VALUES ('4.9999999999'), ('5'), ('-0.0000000001'), ('-5') AS t(x)").select(bars.whole(F.col("x"), 5).alias("n")).collect()]
    assert exact == [0, 1, -1, -1]


def test_streaming_bars_equal_batch_on_ties(spark, ticks, tmp_path):
    df = ticks.where("exchange = 'X' OR symbol = 'A'").select("exchange", "symbol", "ts", "seq", (F.col("side") * F.col("size")).alias("m"))
    cut = T0 + dt.timedelta(hours=12)
    for part in (df.where(F.col("ts") < cut), df.where(F.col("ts") >= cut)):
        part.repartition(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.unit_bars(source, "m", 2).writeStream.format("memory").queryName("tied_bars").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = bars.unit_bars(df, F.col("m"), 2).where("volume_size <> 0")
    assert sorted(map(tuple, spark.table("tied_bars").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_upsert_takes_rows_once(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(minutes=i % 5), float(i), "2024-01-01") for i in range(10)]
    df = spark.createDataFrame(rows, "id string, ts timestamp, v double, day string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.upsert_sink(source, str(tmp_path / "out"), ["id", "ts"], "day", "1 hour").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("id", "ts").distinct().count() == 5


def test_publish_sends_subscribed_symbols(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, v int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.publish(source, spark.createDataFrame([("A",), ("A",)], "symbol string"), lambda batch, epoch: seen.extend(r["json"] for r in batch.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == ['{"symbol":"A","v":1}']


def test_rows_around_changes_by_hand(spark):
    values = [1] * 3 + [2] * 25 + [3] * 2 + [4]
    df = spark.createDataFrame([("X", "A", T0 + dt.timedelta(minutes=i), i, v) for i, v in enumerate(values)], "exchange string, symbol string, ts timestamp, seq long, v int")
    assert sorted(r["ix"] for r in book.with_changes(df, "v", 10).collect()) == [2, 3, 13, 23, 27, 28, 29]


def test_curves_compute_only_what_is_missing(ticks):
    assert curves.missing(["p", "p|diff-1"], ["p|diff-1|mean-4", "p", "p|diff-1|mean-4|abs"]) == [("p|diff-1|mean-4", "p|diff-1", "mean", [4]), ("p|diff-1|mean-4|abs", "p|diff-1|mean-4", "abs", [])]
    for bad in ("q|diff-1", "p|nothing-3"):
        with pytest.raises(KeyError):
            curves.missing(["p"], [bad])
    assert curves.with_curves(ticks, ["v"]) is ticks


def test_store_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("a", T0 + dt.timedelta(days=d), d, f"2024-01-0{1 + d}") for d in range(4)], "id string, ts timestamp, v int, day string")
    store.write_upsert(rows, path, ["id", "ts"], "day")
    kept = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "table" / "day=2024-01-01").iterdir()}
    store.write_without(spark, path, "day", F.col("v") >= 2, "2024-01-01", "2024-01-04")
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [0, 1, 3]
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "table" / "day=2024-01-01").iterdir()} == kept
    assert not (tmp_path / "table" / "day=2024-01-03").exists()


def test_one_series_only_unless_told(spark):
    df = spark.createDataFrame([(T0, 1.0, {"m": "a", "s": "1"}), (T0, 2.0, {"m": "a", "s": "2"})], "ts timestamp, value double, tags map<string,string>")
    with pytest.raises(ValueError):
        store.wide(df, {"m": "a"})
    assert store.wide(df, {"m": "a", "s": "1"}, name="x").columns == ["ts", "x"]
    assert sorted(store.wide(df, {"m": "a"}, more=True).columns) == ["m-a|s-1", "m-a|s-2", "ts"]


def test_unknown_measure_and_open_then_close(spark):
    from tickloom.operators import padding

    with pytest.raises(ValueError):
        scalars.measurable("eur")
    df = spark.createDataFrame([("X", "A", k, *([p] * 4 if p else [None] * 4)) for k, p in enumerate([5.0, None, 7.0, None])], "exchange string, symbol string, volume_tick long, open double, high double, low double, close double")
    got = [r["high"] for r in padding.open_then_close(df).orderBy("volume_tick").collect()]
    assert got == [5.0, 7.0, 7.0, 7.0]
