"""Every tick query against its DuckDB SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tickloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda x: "none" if x is None or x != x else str(x))
        else:
            df[c] = df[c].astype(float).map(lambda x: "none" if x != x else f"{x + 0.0:.6g}")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    got = normal(catalog.queries()[name](spark, SF).toPandas())
    want = normal(duck.sql(catalog.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(spark, name):
    assert not catalog.queries()[name](spark, SF).isEmpty()
