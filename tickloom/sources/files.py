"""Readers and writers of bar files, statistics and executions; schemas are explicit."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.ticks import _numbered, _raw, files_of_days

#: Column names of headerless bar files, after the milliseconds of the day (fixed values).
BAR = ["open", "high", "low", "close", "volume"]
QUOTE_BAR = ["bid_open", "bid_high", "bid_low", "bid_close", "bid_size", "ask_open", "ask_high", "ask_low", "ask_close", "ask_size"]


def zipped_bars(spark: SparkSession, glob: str, names: list[str], start: str, end: str) -> DataFrame:
    """Zip files named yyyymmdd..., one headerless CSV each: ts from milliseconds of the day, the day, and `names` as doubles.

    Zip is no codec that splits, so a file is the unit of work; files of days outside the range are not opened.
    """
    import io
    import zipfile

    import pandas as pd

    chosen = files_of_days(spark, glob, start, end)
    if not chosen:
        return spark.createDataFrame([], "ts timestamp, day date, " + ", ".join(f"{n} double" for n in names))
    files = spark.read.format("binaryFile").load(chosen).select("path", "content")
    files = files.withColumn("day", F.to_date(F.regexp_extract("path", r"(\d{8})[^/]*$", 1), "yyyyMMdd"))
    files = files.where(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).select("day", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for day, content in zip(pdf["day"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        for part in pd.read_csv(z.open(member), header=None, names=["ms", *names], chunksize=100_000):
                            yield part.astype({n: "float64" for n in names}).assign(day=day)

    rows = files.mapInPandas(unpack, "ms long, " + ", ".join(f"{n} double" for n in names) + ", day date")
    return rows.select(bar_time(F.col("day"), F.col("ms")).alias("ts"), "day", *names)


def bar_time(day: Column, ms: Column) -> Column:
    """Day and milliseconds of it as a timestamp."""
    return F.timestamp_millis(F.unix_millis(day.cast("timestamp")) + ms)


def epoch_trades(spark: SparkSession, glob: str, symbol: str) -> DataFrame:
    """Header CSV trades whose time is seconds since 1970; ids and types are left out."""
    rows = _raw(spark, glob, ["TradeId", "Timestamp", "Amount", "Price", "Type"], header=True)
    rows = rows.where(F.col("Timestamp").try_cast("double").isNotNull())
    ts = F.timestamp_millis(F.bround(F.col("Timestamp").cast("double") * 1000).cast("long"))
    number = lambda c: F.col(c).try_cast("decimal(18,8)")
    rows = rows.withColumns({"ts": ts, "symbol": F.lit(symbol), "day": F.to_date(ts)})
    return _numbered(rows, ["symbol"]).select("ts", "seq", "symbol", number("Price").alias("price"), F.abs(number("Amount")).alias("size"), F.when(number("Amount") > 0, 1).otherwise(-1).alias("side"))


def series_columns(kind: str, columns: list[str]) -> list[str]:
    """Columns of a kind of series: `bid` and `ask` by prefix, `deal` the others; ts is always among them."""
    sides = {"bid": lambda c: c.startswith("bid_"), "ask": lambda c: c.startswith("ask_"), "deal": lambda c: not c.startswith(("bid_", "ask_"))}
    return ["ts"] + [c for c in columns if c != "ts" and sides[kind](c)]


def bar_table(spark: SparkSession, glob: str, kind: str, start: str, end: str) -> DataFrame:
    """Bars of a range of days by kind of series."""
    rows = zipped_bars(spark, glob, BAR if kind == "deal" else QUOTE_BAR, start, end)
    return rows.select(series_columns(kind, [c for c in rows.columns if c != "day"]))


def statistics(spark: SparkSession, glob: str, metrics: list[str]) -> DataFrame:
    """One row a JSON file: its name and the chosen entries of `Statistics`; percent and money signs are taken off."""
    rows = spark.read.schema("Statistics map<string,string>").option("multiLine", True).json(glob)
    number = lambda m: F.regexp_replace(F.col("Statistics")[m], r"[%$,]", "").try_cast("double").alias(m)
    return rows.select(F.col("_metadata.file_name").alias("file"), *[number(m) for m in metrics])


def executions(spark: SparkSession, glob: str) -> DataFrame:
    """Execution records, one JSON object a line or an array a file, times parsed, the last record of an id kept."""
    schema = "execID string, orderID string, symbol string, side string, lastQty double, lastPx double, execInst string, avgPx double, cumQty double, commission double, text string, timestamp string"
    rows = spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("ts", F.to_timestamp("timestamp")).where(F.col("execID").isNotNull())
    last = rows.groupBy("execID").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "execID"]), F.struct("ts", "cumQty")).alias("x"))
    return last.select("execID", "x.*").drop("timestamp")


def by_day(df: DataFrame) -> DataFrame:
    """Rows keyed by day and milliseconds of it, as they are exported."""
    day = F.to_date("ts")
    return df.withColumns({"date": day, "ms": F.unix_millis("ts") - F.unix_millis(day.cast("timestamp"))})


def write_by_day(df: DataFrame, path: str) -> None:
    """Parquet by symbol and date; a day of a symbol that is written again replaces what was there."""
    keyed = by_day(df).repartition("symbol", "date").sortWithinPartitions("symbol", "date", "ms")
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("exchange", "symbol", "date").parquet(path)
