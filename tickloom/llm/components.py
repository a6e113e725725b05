"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum and a join back, so a node with very many neighbours is never gathered in one
task; each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import drop_written, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node that has an edge. `edges`: columns a, b of one type."""
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                now.select(F.col("v"), F.col("v")).distinct()
            )
        seen = mark
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select("v", "m").union(low)
        past, now = now, materialise(small.toDF("u", "v").distinct(), "edges")
        drop_written(past)
