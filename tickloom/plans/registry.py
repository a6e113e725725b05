"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Views that oracle texts may use by name.
NAMED = {"ticks": views.TICKS, "quotes": views.QUOTES, "l2": views.L2, "holes": views.HOLES, "daily": views.DAILY}


def query(name: str, view: str, sql: str | None = None):
    """Register `fn(df)` over a view as query `name`; `sql` is its text over the named views."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(views.frame(spark, sf_dir, NAMED[view]))
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return add


def table_query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)` as query `name`."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return add


def oracle(body: str) -> str:
    used = [f"{n} AS ({views.sql(v)})" for n, v in NAMED.items() if n in body]
    head = "WITH " + ", ".join(used) if used else ""
    body = body.strip()
    if head and body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head[5:]}, {body[15:]}"
    if head and body.upper().startswith("WITH "):
        return f"{head}, {body[5:]}"
    return f"{head} {body}"


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles and decimals as doubles of six places, for comparison by value."""
    cols = []
    for name, kind in df.dtypes:
        numeric = kind in ("double", "float") or kind.startswith("decimal")
        cols.append((F.round(F.col(name).cast("double"), 6) + 0.0).alias(name) if numeric and name not in keep else F.col(name))
    return df.select(*cols)
