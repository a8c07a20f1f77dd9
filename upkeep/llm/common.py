"""Shared helpers of the operators: table reads, written intermediates, prefix sums."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upkeep.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, row
    ids become stable and a lost executor costs nothing but a re-read."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c):
    """Lower-case A-Z only. Pure-ASCII texts take ``lower`` (same result there);
    others map the 26 letters one by one."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def prefix_sums(df: DataFrame, by: list[str], order: list[str], value: str, out: str, name: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``by`` in ``order``, without a
    window over a whole group: rows are range-partitioned on (by, order), each
    partition sums its own part and adds the totals of the parts before it. A
    hot group therefore spreads over many tasks. ``order`` should end in a
    unique column; null keys form a group of their own."""
    keys = [F.col(c).asc_nulls_first() for c in by + order]
    cut = written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), name)
    part = cut.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"),
                          F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    on = cut["_part"] == offsets["_p"]
    for i, c in enumerate(by):
        on = on & cut[c].eqNullSafe(offsets[f"_k{i}"])
    within = Window.partitionBy(*by, "_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(value).over(within), F.lit(0))
    return (cut.join(offsets, on, "left").withColumn(out, F.col("_before") + run)
            .drop("_part", "_p", "_before", *[f"_k{i}" for i in range(len(by))]))
