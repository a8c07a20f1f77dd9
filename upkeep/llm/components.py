"""Connected components by alternating large-star and small-star steps.

Every step is a pre-aggregated minimum per node and one equi join back, so a
node with very many links is split by adaptive execution; the edges between
steps are written tables. Rounds grow with the logarithm of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import written


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: the smallest node of each node's component, for every
    node that has an edge. Nulls and loops are ignored."""
    at = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    last = None
    while True:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
        large = written(both.join(least, F.col("u") == F.col("w")).where("v > u")
                        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "least")
        hung = large.join(least, F.col("u") == F.col("w"))
        small = (hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        at = written(small, "stars")
        now = tuple(at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
