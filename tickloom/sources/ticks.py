"""Tick readers: gzip CSV in, typed rows with a total order out. Schemas are explicit, corrupt rows are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files_of_days(spark: SparkSession, glob: str, start: str, end: str, dated: bool = True) -> list[str]:
    """Files of a glob whose name begins with a day (yyyymmdd) from `start` to `end`; only names are read to choose them.

    Names without a day are left out, or taken too if the files are not all to be `dated`.
    """
    first, last = start.replace("-", ""), end.replace("-", "")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    named = [(f.getPath().getName()[:8], f.getPath().toString()) for f in found]
    has_day = lambda day: len(day) == 8 and day.isdigit()
    return sorted(path for day, path in named if (first <= day <= last if has_day(day) else not dated))


def _next_day(day: str) -> str:
    import datetime

    return str(datetime.date.fromisoformat(day) + datetime.timedelta(days=1))


def _raw(spark: SparkSession, glob: str | list[str], names: list[str], header: bool) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in names)
    if not glob:
        return spark.createDataFrame([], f"{schema}, __file string, __line long, day date")
    rows = spark.read.schema(schema).option("header", header).csv(glob)
    rows = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.monotonically_increasing_id().alias("__line"))
    return rows.withColumn("day", F.to_date(F.regexp_extract("__file", r"^(\d{8})", 1), "yyyyMMdd"))


def headerless(spark: SparkSession, glob: str, names: list[str], start: str, end: str) -> DataFrame:
    """Files named yyyymmdd...; days from `start` to `end`; the first column is seconds of the day."""
    rows = _raw(spark, files_of_days(spark, glob, start, end), names, header=False)
    rows = rows.where(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    good = rows.where(F.col(names[0]).try_cast("double").isNotNull() & (F.length(names[0]) <= 9))
    millis = F.unix_millis(F.col("day").cast("timestamp")) + F.bround(F.col(names[0]).cast("double") * 1000).cast("long")
    return good.withColumn("ts", F.timestamp_millis(millis))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "day").orderBy("__file", "__line")
    return rows.withColumn("seq", F.row_number().over(w).cast("long")).drop("__file", "__line")


def trades(spark: SparkSession, glob: str, symbol: str, start: str, end: str, exchange: str = "plain") -> DataFrame:
    """ts, seq, exchange, symbol, price, size (absolute), side (1 or -1)."""
    rows = headerless(spark, glob, ["sec_of_day", "price", "size", "side"], start, end)
    rows = _numbered(rows.withColumn("symbol", F.lit(symbol)), ["symbol"])
    number = lambda c: F.col(c).try_cast("decimal(18,8)")
    return rows.select("ts", "seq", F.lit(exchange).alias("exchange"), "symbol", number("price").alias("price"), F.abs(number("size")).alias("size"), F.when(F.col("side") == "Buy", 1).otherwise(-1).alias("side"))


def quotes(spark: SparkSession, glob: str, symbol: str, start: str, end: str, exchange: str = "plain") -> DataFrame:
    """ts, seq, exchange, symbol, price, size (signed), count, side; count 0 removes a level. No files give no rows."""
    rows = headerless(spark, glob, ["sec_of_day", "price", "size", "count"], start, end)
    rows = _numbered(rows.withColumn("symbol", F.lit(symbol)), ["symbol"])
    number = lambda c: F.col(c).try_cast("decimal(18,8)")
    return rows.select("ts", "seq", F.lit(exchange).alias("exchange"), "symbol", number("price").alias("price"), number("size").alias("size"), F.col("count").try_cast("int").alias("count"), F.when(number("size") > 0, 1).otherwise(-1).alias("side"))


_RICH = ["timestamp", "symbol", "side", "size", "price", "tickDirection", "grossValue", "homeNotional", "foreignNotional"]


def rich_trades(spark: SparkSession, glob: str, symbol: str, start: str, end: str, exchange: str = "rich") -> DataFrame:
    """Header CSV trades of one symbol, days from `start` to the day after `end`."""
    rows = _raw(spark, files_of_days(spark, glob, start, _next_day(end), dated=False), _RICH, header=True).where(F.col("symbol") == symbol)
    ts = F.to_timestamp(F.concat(F.substring("timestamp", 1, 10), F.lit(" "), F.substring("timestamp", 12, 15)))
    rows = rows.withColumn("ts", ts).where(F.to_date("ts").between(F.to_date(F.lit(start)), F.date_add(F.to_date(F.lit(end)), 1)))
    cols = [F.col(c).try_cast("double").alias(c) for c in ("price", "size", "grossValue", "homeNotional", "foreignNotional")]
    return _numbered(rows, ["symbol"]).select("ts", "seq", F.lit(exchange).alias("exchange"), "symbol", F.when(F.col("side") == "Buy", 1).otherwise(-1).alias("side"), *cols)


_RICH_QUOTES = ["timestamp", "symbol", "bidSize", "bidPrice", "askPrice", "askSize"]


def rich_quotes(spark: SparkSession, glob: str, symbol: str, start: str, end: str, exchange: str = "rich") -> DataFrame:
    """Header CSV quotes of one symbol (bid, ask and their sizes), days from `start` to the day after `end`."""
    rows = _raw(spark, files_of_days(spark, glob, start, _next_day(end), dated=False), _RICH_QUOTES, header=True).where(F.col("symbol") == symbol)
    ts = F.to_timestamp(F.concat(F.substring("timestamp", 1, 10), F.lit(" "), F.substring("timestamp", 12, 15)))
    rows = rows.withColumn("ts", ts).where(F.to_date("ts").between(F.to_date(F.lit(start)), F.date_add(F.to_date(F.lit(end)), 1)))
    named = {"bid": "bidPrice", "ask": "askPrice", "bid_size": "bidSize", "ask_size": "askSize"}
    return _numbered(rows, ["symbol"]).select("ts", "seq", F.lit(exchange).alias("exchange"), "symbol", *[F.col(c).try_cast("double").alias(k) for k, c in named.items()])


READERS = {"plain": (trades, quotes), "rich": (rich_trades, rich_quotes)}


def _loaded(spark: SparkSession, which: int, sources: list[tuple[str, str, str, str]], start: str, end: str) -> DataFrame:
    """Rows of all sources, numbered by exchange, symbol and day: two sources of one series follow each other in their order."""
    out = None
    for at, (exchange, kind, glob, symbol) in enumerate(sources):
        rows = READERS[kind][which](spark, glob, symbol, start, end, exchange).withColumn("__at", F.lit(at))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if len({(s[0], s[3]) for s in sources}) == len(sources):
        return out.drop("__at")
    w = Window.partitionBy("exchange", "symbol", F.to_date("ts")).orderBy("__at", "seq")
    return out.withColumn("seq", F.row_number().over(w).cast("long")).drop("__at")


def load_trades(spark: SparkSession, sources: list[tuple[str, str, str, str]], start: str, end: str) -> DataFrame:
    """One table of the trades of many sources, given as (exchange, reader, glob, symbol)."""
    return _loaded(spark, 0, sources, start, end)


def load_quotes(spark: SparkSession, sources: list[tuple[str, str, str, str]], start: str, end: str) -> DataFrame:
    """One table of the quotes of many sources, given as (exchange, reader, glob, symbol); columns that a reader lacks are null."""
    return _loaded(spark, 1, sources, start, end)
