"""Partitions of all names in the store; series of several exchanges; files that are opened."""

import datetime as dt
import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, store
from tickloom.sources import files, ticks

NAMES = ["a:b", "c", None, "01", "1", "2024-01-01", "x/y", "50%", "p=q", " "]
AT = dt.datetime(2024, 1, 1)


def rows(spark, values):
    return spark.createDataFrame([(i, AT + dt.timedelta(hours=i), p, v) for i, p, v in values], "id long, ts timestamp, part string, v int")


def stored(spark, path):
    return sorted(((r["id"], r["part"], r["v"]) for r in store._stored(spark, path, "part").collect()), key=str)


@pytest.fixture
def path(spark, tmp_path):
    where = str(tmp_path / "table")
    store.write_upsert(rows(spark, [(i, p, 0) for i, p in enumerate(NAMES)]), where, ["id", "part"], "part")
    return where


def test_upserts_touch_their_partitions_only(spark, path):
    store.write_upsert(rows(spark, [(i, p, 1) for i, p in enumerate(NAMES) if i % 2 == 0] + [(100 + i, p, 2) for i, p in enumerate(NAMES)]), path, ["id", "part"], "part")
    want = [(i, p, int(i % 2 == 0)) for i, p in enumerate(NAMES)] + [(100 + i, p, 2) for i, p in enumerate(NAMES)]
    assert stored(spark, path) == sorted(want, key=str)


def test_null_keys_are_replaced(spark, tmp_path):
    where = str(tmp_path / "t")
    for i, v in ((None, 1), (None, 2), (3, 3)):
        store.write_upsert(rows(spark, []).union(spark.createDataFrame([(i, AT, None, v)], "id long, ts timestamp, part string, v int")), where, ["id", "part"], "part")
    assert stored(spark, where) == [(3, None, 3), (None, None, 2)]


def test_columns_that_new_rows_lack_are_kept(spark, path):
    store.write_upsert(rows(spark, [(50, "c", 5)]).drop("v"), path, ["id"], "part")
    assert (1, "c", 0) in stored(spark, path) and (50, "c", None) in stored(spark, path)


@pytest.mark.parametrize("gone", [[0, 1, 2], [3], [4, 6, 7, 8, 9], list(range(len(NAMES)))])
def test_deletes_empty_partitions_of_all_names(spark, path, gone):
    store.write_without(spark, path, "part", F.col("id").isin(gone), "2024-01-01", "2025-01-01")
    left = [(i, p, 0) for i, p in enumerate(NAMES) if i not in gone]
    if left:
        assert stored(spark, path) == sorted(left, key=str)
    else:
        assert store._stored(spark, path, "part") is None
        store.write_without(spark, path, "part", F.lit(True), "2024-01-01", "2025-01-01")
        store.write_upsert(rows(spark, [(1, None, 1)]), path, ["id"], "part")
        assert stored(spark, path) == [(1, None, 1)]


def test_deletes_rewrite_what_is_left(spark, path):
    store.write_upsert(rows(spark, [(100 + i, p, 2) for i, p in enumerate(NAMES)]), path, ["id", "part"], "part")
    store.write_without(spark, path, "part", F.col("v") == 2, "2024-01-01", "2024-01-05T08:00:00")
    assert stored(spark, path) == sorted([(i, p, 0) for i, p in enumerate(NAMES)] + [(100 + i, p, 2) for i, p in enumerate(NAMES) if i > 3], key=str)


def test_deletes_see_the_partition_column(spark, tmp_path):
    where = str(tmp_path / "days")
    days = spark.createDataFrame([(i, AT + dt.timedelta(days=i), dt.date(2024, 1, 1 + i)) for i in range(4)], "id long, ts timestamp, day date")
    store.write_upsert(days, where, ["id"], "day")
    store.write_without(spark, where, "day", F.col("day") == F.lit(dt.date(2024, 1, 2)), "2024-01-01", "2025-01-01")
    assert sorted(r["id"] for r in spark.read.parquet(where).collect()) == [0, 2, 3]


def test_many_emptied_partitions(spark, tmp_path):
    where = str(tmp_path / "many")
    many = spark.range(1500).select("id", F.lit(AT).alias("ts"), F.concat(F.lit("k:"), "id").alias("part"), F.lit(0).alias("v"))
    store.write_upsert(many.coalesce(2), where, ["id"], "part")
    store.write_without(spark, where, "part", F.col("id") < 1499, "2024-01-01", "2025-01-01")
    assert stored(spark, where) == [(1499, "k:1499", 0)]


def write(path, text):
    with gzip.open(path, "wt") as f:
        f.write(text)


def test_two_exchanges_are_two_series(spark, tmp_path):
    for name, rows_ in (("20240102_deal_x.csv.gz", 3), ("20240102_deal_y.csv.gz", 5)):
        write(tmp_path / name, "".join(f"{i}.0,{100 + i},1,Buy\n" for i in range(rows_)))
    sources = [(e, "plain", str(tmp_path / f"*_deal_{e}*"), "A") for e in ("x", "y")]
    loaded = ticks.load_trades(spark, sources, "2024-01-01", "2024-01-02")
    assert loaded.groupBy("exchange", "symbol", "seq").count().where("count > 1").isEmpty()
    made = bars.unit_bars(loaded, F.col("size").cast("decimal(18,8)"), 2).groupBy("exchange").count()
    assert {r["exchange"]: r["count"] for r in made.collect()} == {"x": 1, "y": 2}
    same = ticks.load_trades(spark, [("x", *s[1:]) for s in sources], "2024-01-01", "2024-01-02")
    assert sorted(r["seq"] for r in same.collect()) == list(range(1, 9))


def test_quotes_of_two_exchanges(spark, tmp_path):
    write(tmp_path / "20240102_quote_x.csv.gz", "1.5,100.25,-2,3\n2,100,4,0\n")
    write(tmp_path / "20240102_quote_y.csv.gz", "timestamp,symbol,bidSize,bidPrice,askPrice,askSize\n2024-01-02D00:00:01.500000000,A,3,99.5,100.5,4\n")
    got = ticks.load_quotes(spark, [("x", "plain", str(tmp_path / "*_quote_x*"), "A"), ("y", "rich", str(tmp_path / "*_quote_y*"), "A")], "2024-01-01", "2024-01-02")
    assert sorted((r["exchange"], r["seq"], r["count"], r["bid"]) for r in got.collect()) == [("x", 1, 3, None), ("x", 2, 0, None), ("y", 1, None, 99.5)]


def test_only_files_of_the_days_asked_for_are_opened(spark, tmp_path):
    for day in ("20240101", "20240102", "20240103", "20240105"):
        write(tmp_path / f"{day}_deal.csv.gz", "1.0,100,1,Buy\n")
        with zipfile.ZipFile(tmp_path / f"{day}_bars.zip", "w") as z:
            z.writestr("bars.csv", "0,1,2,0.5,1.5,10\n")
    got = ticks.trades(spark, str(tmp_path / "*_deal*"), "A", "2024-01-02", "2024-01-04")
    assert sorted(f.rpartition("/")[2][:8] for f in got.inputFiles()) == ["20240102", "20240103"] and got.count() == 2
    rich = ticks.rich_trades(spark, str(tmp_path / "*_deal*"), "A", "2024-01-02", "2024-01-02")
    assert len(rich.inputFiles()) == 2
    zipped = files.zipped_bars(spark, str(tmp_path / "*.zip"), files.BAR, "2024-01-05", "2024-01-09")
    assert zipped.count() == 1 and len(zipped.inputFiles()) == 1
    assert ticks.trades(spark, str(tmp_path / "*_deal*"), "A", "2025-01-02", "2025-01-04").isEmpty()
