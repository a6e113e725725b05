"""Readers and writers of files made in the test."""

import datetime as dt
import json
import zipfile

from tickloom.operators import store
from tickloom.sources import files


def test_zipped_bars_of_a_range_of_days(spark, tmp_path):
    for day, rows in {"20240101": "0,1,2,0.5,1.5,10\n60000,1.5,3,1,2,5\n", "20240102": "1000,7,7,7,7,1\n", "20240103": "0,9,9,9,9,9\n"}.items():
        with zipfile.ZipFile(tmp_path / f"{day}_deal.zip", "w") as z:
            z.writestr("bars.csv", rows)
    got = files.bar_table(spark, str(tmp_path / "*.zip"), "deal", "2024-01-01", "2024-01-02").orderBy("ts").collect()
    assert [(r["ts"], r["close"]) for r in got] == [(dt.datetime(2024, 1, 1), 1.5), (dt.datetime(2024, 1, 1, 0, 1), 2.0), (dt.datetime(2024, 1, 2, 0, 0, 1), 7.0)]
    assert files.bar_table(spark, str(tmp_path / "*.zip"), "deal", "2025-01-01", "2025-01-02").isEmpty()


def test_kinds_of_columns():
    assert files.series_columns("ask", ["ts", "bid_open", "ask_open", "close"]) == ["ts", "ask_open"]
    assert files.series_columns("deal", ["ts", "bid_open", "ask_open", "close"]) == ["ts", "close"]


def test_epoch_trades(spark, tmp_path):
    (tmp_path / "t.csv").write_text("TradeId,Timestamp,Amount,Price,Type\n1,1704067200.5,-2,100,x\n2,bad,1,1,x\n3,1704067201,3,101,x\n")
    got = files.epoch_trades(spark, str(tmp_path / "t.csv"), "A").orderBy("seq").collect()
    assert [(r["ts"], float(r["size"]), r["side"]) for r in got] == [(dt.datetime(2024, 1, 1, 0, 0, 0, 500000), 2.0, -1), (dt.datetime(2024, 1, 1, 0, 0, 1), 3.0, 1)]


def test_statistics_and_executions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"Statistics": {"Net Profit": "12.5%", "Fees": "$1,000.25"}, "Other": [1]}, indent=1))
    assert [tuple(r) for r in files.statistics(spark, str(tmp_path / "a.json"), ["Net Profit", "Fees", "None"]).collect()] == [("a.json", 12.5, 1000.25, None)]
    rows = [{"execID": "e", "cumQty": q, "timestamp": f"2024-01-01T00:00:0{q}.000Z"} for q in (1, 2)]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    got = files.executions(spark, str(tmp_path / "x.json")).collect()
    assert len(got) == 1 and got[0]["cumQty"] == 2 and got[0]["ts"] == dt.datetime(2024, 1, 1, 0, 0, 2)


def test_a_day_written_again_replaces_only_itself(spark, tmp_path):
    day = lambda d, v: spark.createDataFrame([("X", "A", dt.datetime(2024, 1, d, 1), v)], "exchange string, symbol string, ts timestamp, v int")
    for df in (day(1, 1), day(2, 2), day(2, 3)):
        files.write_by_day(df, str(tmp_path / "out"))
    assert sorted((str(r["date"]), r["ms"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("2024-01-01", 3600000, 1), ("2024-01-02", 3600000, 3)]


def test_experiment_stages(spark, tmp_path):
    stage = lambda s, v: spark.createDataFrame([("e", s, v)], "ex string, stage string, v int")
    for df in (stage("a", 1), stage("b", 2), stage("b", 3)):
        store.write_experiment(df, str(tmp_path / "ex"))
    assert sorted((r["stage"], r["v"]) for r in spark.read.parquet(str(tmp_path / "ex")).collect()) == [("a", 1), ("b", 3)]


def test_points_that_share_tags_after_retagging_become_one(spark):
    rows = [(dt.datetime(2024, 1, 1), v, {"measurement": m, "side": s}) for v, m, s in ((1.0, "b", "x"), (2.0, "b", "y"), (3.0, "c", "x"))]
    df = spark.createDataFrame(rows, "ts timestamp, value double, tags map<string,string>")
    got = store.retagged(df, "b", ["side"]).orderBy("value").collect()
    assert [(r["value"], r["tags"]) for r in got] == [(2.0, {"measurement": "b"}), (3.0, {"measurement": "c", "side": "x"})]


def test_quotes_and_header_readers(spark, tmp_path):
    import gzip

    from tickloom.sources import ticks

    def write(name, text):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)

    write("20240102_quote.csv.gz", "1.5,100.25,-2,3\n2,100,4,0\nbad,1,1,1\n3,x,1,1\n")
    q = ticks.quotes(spark, str(tmp_path / "*_quote*"), "A", "2024-01-01", "2024-01-03").orderBy("seq").collect()
    assert [(r["ts"].second, float(r["size"]), r["count"], r["side"]) for r in q][:2] == [(1, -2.0, 3, -1), (2, 4.0, 0, 1)]
    head = "timestamp,symbol,side,size,price,tickDirection,grossValue,homeNotional,foreignNotional\n"
    row = "2024-01-02D00:00:0{i}.000000000,{s},{side},5,100.5,Zero,7,0.05,5\n"
    write("20240102_rich.csv.gz", head + row.format(i=1, s="A", side="Buy") + row.format(i=2, s="B", side="Buy") + row.format(i=3, s="A", side="Sell"))
    t = ticks.rich_trades(spark, str(tmp_path / "*_rich*"), "A", "2024-01-01", "2024-01-02").orderBy("seq").collect()
    assert [(r["ts"].second, r["side"], r["homeNotional"]) for r in t] == [(1, 1, 0.05), (3, -1, 0.05)]
    write("20240102_book.csv.gz", "timestamp,symbol,bidSize,bidPrice,askPrice,askSize\n2024-01-02D00:00:01.500000000,A,3,99.5,100.5,4\n2024-01-05D00:00:01.500000000,A,3,1,2,4\n")
    b = ticks.rich_quotes(spark, str(tmp_path / "*_book*"), "A", "2024-01-01", "2024-01-02").collect()
    assert [(r["bid"], r["ask"], r["bid_size"], r["ask_size"]) for r in b] == [(99.5, 100.5, 3.0, 4.0)]
    write("20240102_deal.csv.gz", "1.0,100,2,Buy\n")
    sources = [("x", "plain", str(tmp_path / "*_deal*"), "A"), ("y", "rich", str(tmp_path / "*_rich*"), "A")]
    both = ticks.load_trades(spark, sources, "2024-01-01", "2024-01-02")
    assert sorted((r["exchange"], r["seq"]) for r in both.collect()) == [("x", 1), ("y", 1), ("y", 2)]
