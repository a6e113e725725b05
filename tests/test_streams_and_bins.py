"""Streaming folds against batch over several micro-batches, parabolic stop, bins, two actions."""

import datetime as dt

from pyspark.sql import functions as F

from tickloom.functions import indicators as ta
from tickloom.operators import bars, binning
from tickloom.streaming import bars as stream

T0 = dt.datetime(2024, 1, 1)


def frame(spark, n=90, step=3600):
    rows = [("X", s, T0 + dt.timedelta(seconds=step * i), i, float((i * 7 + j) % 11 - 5), 100.0 + (i * 5 + j) % 9, float((i % 5 + 1) * (1 if (i * 5 + j) % 9 < 4 else -1)), i % 4) for j, s in enumerate("AB") for i in range(n)]
    return spark.createDataFrame(rows, "exchange string, symbol string, ts timestamp, seq long, m double, price double, size double, count int")


def run(spark, tmp_path, df, make, name):
    """The rows of a stream that reads three files in order, one a micro-batch."""
    for i in range(3):
        df.where((F.col("seq") >= 30 * i) & (F.col("seq") < 30 * (i + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return sorted(spark.table(name).collect(), key=str)


def test_sequence_bars(spark, tmp_path):
    df = frame(spark)
    got = run(spark, tmp_path, df, lambda s: stream.sequence_bars(s, "m", 9.0), "seq_bars")
    assert got == sorted(bars.sequence_bars(df, F.col("m"), 9.0).withColumn("sequence", F.col("sequence").cast("int")).collect(), key=str)


def test_delta_sampling(spark, tmp_path):
    df = frame(spark)
    got = run(spark, tmp_path, df, lambda s: stream.delta_sampling(s, "m", 4.0), "delta_rows")
    assert got == sorted(bars.delta_sampling(df, "m", 4.0).collect(), key=str)


def test_best_prices_start_anew_each_day(spark, tmp_path):
    df = frame(spark)
    got = run(spark, tmp_path, df, lambda s: stream.best_prices(s), "best_rows")
    clean = lambda rows: sorted(str([None if x != x else x for x in r]) for r in rows)
    assert clean(got) == clean(bars.best_prices(df).collect())


def shuffled(spark, tmp_path, df, make, name, files=6):
    """The rows of a stream whose files hold its rows in no order, and a last file that moves the watermark beyond them."""
    parts = df.withColumn("__f", F.pmod(F.xxhash64("symbol", "seq"), F.lit(files)))
    for i in range(files):
        parts.where(F.col("__f") == i).drop("__f").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = df.limit(1).withColumns({"symbol": F.lit("end"), "ts": F.lit(T0 + dt.timedelta(days=90))}).select(df.columns)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return sorted((r for r in spark.table(name).collect() if r["symbol"] != "end"), key=str)


def test_rows_in_no_order_give_the_batch_result(spark, tmp_path):
    df, late = frame(spark), "10 days"
    assert shuffled(spark, tmp_path / "a", df, lambda s: stream.sequence_bars(s, "m", 9.0, late), "late_runs") == sorted(bars.sequence_bars(df, F.col("m"), 9.0).collect(), key=str)
    assert shuffled(spark, tmp_path / "b", df, lambda s: stream.delta_sampling(s, "m", 4.0, late), "late_drift") == sorted(bars.delta_sampling(df, "m", 4.0).collect(), key=str)
    clean = lambda rows: sorted(str([None if x != x else x for x in r]) for r in rows)
    assert clean(shuffled(spark, tmp_path / "c", df, lambda s: stream.best_prices(s, late), "late_best")) == clean(bars.best_prices(df).collect())
    tied = df.withColumn("ts", F.date_trunc("day", "ts"))
    assert shuffled(spark, tmp_path / "d", tied, lambda s: stream.unit_bars(s, "m", 2, late), "late_bars") == sorted(bars.unit_bars(tied, F.col("m"), 2).where("volume_size <> 0").collect(), key=str)


def test_rows_beyond_the_watermark_are_left_out(spark, tmp_path):
    df = frame(spark, 60)
    for rows in (df.where("seq >= 30"), df.where("seq < 2"), df.where("seq = 59").withColumn("ts", F.lit(T0 + dt.timedelta(days=9)))):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.delta_sampling(source, "m", 0.0, "1 hour").writeStream.format("memory").queryName("too_late").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["seq"] for r in spark.table("too_late").collect() if r["symbol"] == "A") == list(range(30, 60))


def test_scored_bars(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df = frame(spark)
    batch = bars.time_bars(df, "2 hours").select("exchange", "symbol", "ts", "open", "close")
    edges = binning.kmeans_edges(batch.withColumn("key", F.concat("exchange", "symbol", "ts")), ["open", "close"], "key", 3)
    model = Pipeline(stages=[VectorAssembler(inputCols=["open"], outputCol="features"), LinearRegression(labelCol="close")]).fit(binning.coded(batch, edges))
    got = run(spark, tmp_path, df, lambda s: stream.scored(s, "2 hours", "0 seconds", edges, model), "scored_rows")
    want = {(r["exchange"], r["symbol"], r["ts"]): r["prediction"] for r in model.transform(binning.coded(batch, edges)).collect()}
    assert len(got) >= 80 and all(abs(want[r["exchange"], r["symbol"], r["ts"]] - r["prediction"]) < 1e-9 for r in got)


def test_parabolic_stop_of_a_rise_and_a_fall(spark):
    highs = [10, 11, 12, 13, 14, 9, 8]
    df = spark.createDataFrame([("X", "A", T0 + dt.timedelta(days=i), i, float(h), float(h - 1)) for i, h in enumerate(highs)], "exchange string, symbol string, ts timestamp, seq long, h double, l double")
    got = [r["sar"] for r in ta.with_sar(df, "h", "l").orderBy("seq").collect()]
    # worked by hand: start at the low of the first bar, shares .02, .04, .06, .08; the fall at bar 5 turns it to the highest high
    second = 9 + 0.02 * (11 - 9)
    third = second + 0.04 * (12 - second)
    fourth = third + 0.06 * (13 - third)
    want = [None, 9.0, second, third, fourth, 14.0]
    assert got[0] is None and all(abs(a - b) < 1e-9 for a, b in zip(got[1:6], want[1:]))
    assert abs(got[6] - max(14 + 0.02 * (8 - 14), 14, 9)) < 1e-9
    signed = [r["sar"] for r in ta.with_sar(df, "h", "l", signed=True).orderBy("seq").collect()]
    assert signed[5:] == [-got[5], -got[6]]
    assert ta.with_sar(df.limit(1), "h", "l").first()["sar"] is None


def test_bins_of_separate_groups_and_odd_columns(spark):
    df = spark.createDataFrame([(i, float(i % 3 * 100 + i % 2), 5.0, None) for i in range(60)], "k int, a double, b double, c double")
    edges = binning.kmeans_edges(df, ["a", "b", "c"], "k", 3)
    assert len(edges["a"]) == 2 and edges["b"] == [] and edges["c"] == []
    got = binning.coded(df, edges).groupBy("a", "b", "c").count().orderBy("a").collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, None, 20), (1.0, 0.0, None, 20), (2.0, 0.0, None, 20)]


def test_two_actions_average_models(spark):
    from pyspark.ml.feature import SQLTransformer

    states = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, x double")
    models = [SQLTransformer(statement=f"SELECT *, x * {k} + action AS prediction FROM __THIS__") for k in (1, 3)]
    assert [tuple(r) for r in binning.two_actions(models, states, ["id"]).orderBy("id").collect()] == [(1, 4.0, 5.0), (2, 6.0, 7.0)]
