"""Python gets the columns that a recurrence needs, not whole ticks."""

from tickloom.plans import catalog


def test_weighted_volatility_sends_no_decimals(spark):
    plan = catalog.queries()["g12_volatility_weighted"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    folds = [line for line in plan.splitlines() if "FlatMapGroupsInPandas" in line]
    assert folds and not any(c in line for line in folds for c in ("size#", "price#", "side#"))
