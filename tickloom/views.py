"""Canonical views of the given tables: the same rows as a DataFrame and as DuckDB SQL.

Timestamps are read as TIMESTAMP (session zone UTC); `seq` completes the order among equal timestamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TICKS = """
SELECT CAST(ts AS TIMESTAMP) AS ts, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'Y' ELSE 'X' END AS exchange,
       concat('S', CAST(user_id % 5 AS {string})) AS symbol,
       CAST(100 + value AS DECIMAL(18,2)) AS price,
       CAST((1 + event_id % 7) * CASE WHEN event_id % 11 = 0 THEN 0.004 ELSE 1 END AS DECIMAL(18,8)) AS size,
       CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE -1 END AS side
FROM {events}"""

QUOTES = """
SELECT ts, seq, exchange, symbol, price - 0.05 * (1 + seq % 3) AS bid, price + 0.05 * (1 + seq % 4) AS ask,
       10 + seq % 11 AS bid_size, 10 + seq % 13 AS ask_size
FROM {ticks} t WHERE seq % 3 <> 0"""

L2 = """
SELECT ts, seq, exchange, symbol, 100 + 0.5 * (seq % 40) AS price,
       CASE WHEN 100 + 0.5 * (seq % 40) < 110 THEN 1 ELSE -1 END * (1 + seq % 5) AS size, seq % 4 AS count
FROM {ticks} t"""

HOLES = """
SELECT ts, seq, exchange, symbol, CASE WHEN seq % 5 IN (1, 2) THEN NULL ELSE CAST(price AS DOUBLE) END AS price, size, side FROM {ticks} t"""

DAILY = """
SELECT o_orderdate AS day, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
       min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, count(*) AS volume
FROM {orders} GROUP BY o_orderdate"""


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a view's text on Spark over the parquet files of `sf_dir`."""
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("events", "orders", "lineitem", "part", "supplier", "customer")}
    ticks = "(" + TICKS.format(string="STRING", **names) + ")"
    return spark.sql(text.format(string="STRING", ticks=ticks, **names))


def sql(text: str) -> str:
    """A view's text for DuckDB, where the tables are registered under their names."""
    names = {t: t for t in ("events", "orders", "lineitem", "part", "supplier", "customer")}
    ticks = "(" + TICKS.format(string="VARCHAR", **names) + ")"
    return text.format(string="VARCHAR", ticks=ticks, **names)
