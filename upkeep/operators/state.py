"""A per-key state table that later drops of rows are merged into.

The state holds one row per key: the latest date, the earliest row on ties
(``latest_per_key``). Its rows lie in hash buckets of the key, and a manifest says for
each bucket which folder holds it now. A merge reduces the new rows to one per key,
reads only the buckets that their keys fall into, writes these anew to a folder of its
own and appends one line a bucket to the manifest, which is the commit: a merge that
fails before leaves the state as it was, one that is repeated gives the same state.
Older folders stay readable until ``bucket_folders`` no longer names them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.operators.windows import latest_per_key
from upkeep.session import materialize

BUCKET = "key_bucket"


class KeyedState:
    """State at ``path`` of rows with the columns of ``schema`` (a DDL string or StructType)."""

    def __init__(self, spark: SparkSession, path: str, schema, key: str, date_col: str, order_col: str = "row_ord", buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets
        self.key, self.date_col, self.order_col = key, date_col, order_col

    def bucket_folders(self) -> dict[int, str]:
        """Bucket -> folder that holds its rows now (at most ``buckets`` entries)."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return {}
        lines = self.spark.read.schema("seq long, bucket int, folder string").parquet(f"{self.path}/manifest")
        return {r["bucket"]: r["folder"] for r in lines.groupBy("bucket").agg(F.max_by("folder", "seq").alias("folder")).collect()}

    def rows(self, only: list[int] | None = None) -> DataFrame:
        """The state's rows, or those of some buckets."""
        folders = self.bucket_folders()
        paths = [f"{self.path}/rows-{f}/{BUCKET}={b}" for b, f in folders.items() if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema if not isinstance(self.schema, str) else self.spark.createDataFrame([], self.schema).schema).parquet(*paths)

    def merge(self, drop: DataFrame) -> list[int]:
        """Merges a drop of rows; returns the buckets it touched. Rows without a key are out."""
        columns = self.spark.createDataFrame([], self.schema).columns
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)
        new = latest_per_key(drop.select(*columns).where(F.col(self.key).isNotNull()), self.key, self.date_col, self.order_col).select(*columns)
        folder = uuid.uuid4().hex
        mine = materialize(new.select("*", bucket))
        touched = sorted(r[0] for r in mine.select(BUCKET).distinct().collect())
        if not touched:
            return []
        both = self.rows(touched).unionByName(mine.drop(BUCKET))
        merged = latest_per_key(both, self.key, self.date_col, self.order_col).select(*columns, bucket)
        merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/rows-{folder}")
        known = self.bucket_folders()
        seq = 1 + (self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("seq")).first()[0] if known else 0)
        lines = self.spark.createDataFrame([(seq, b, folder) for b in touched], "seq long, bucket int, folder string")
        lines.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return touched
