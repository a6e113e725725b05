"""Models of two actions without a shuffle of the rows that they score."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tickloom.operators import binning
from tickloom.plans import catalog


def test_a_tree_on_cells_is_the_tree_on_rows(spark):
    """Ten values a column: cells lose nothing."""
    rows = spark.range(6000).select((F.col("id") % 10).cast("double").alias("a"), (F.floor(F.col("id") / 10) % 7).cast("double").alias("b"), (F.floor(F.col("id") / 70) % 2).cast("double").alias("action"), F.col("id"))
    rows = rows.withColumn("label", F.col("a") * F.col("a") + F.col("b") * F.col("b") * 1.3 + F.col("action") * (F.col("a") + 40.0))
    state = VectorAssembler(inputCols=["a", "b", "action"], outputCol="features")
    want = Pipeline(stages=[state, DecisionTreeRegressor(maxDepth=4, seed=7)]).fit(rows).transform(rows)
    got = binning.fit_tree_on_cells(rows, ["a", "b"], "action", "label", 4).transform(rows)
    pairs = want.select("id", F.col("prediction").alias("w")).join(got.select("id", "prediction"), "id")
    assert pairs.agg(F.max(F.abs(F.col("w") - F.col("prediction")))).first()[0] < 1e-6


def test_scores_are_not_shuffled(spark):
    df = catalog.queries()["u08_two_actions"](spark, "/root/testdata/sf0.001")
    above = df._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert not any(x in above for x in ("Exchange", "Aggregate", "Union", "Join"))
    assert df.count() == catalog.queries()["x02_deal_curves"](spark, "/root/testdata/sf0.001").count()
