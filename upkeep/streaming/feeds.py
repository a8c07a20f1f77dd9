"""Incremental jobs over folders that receive new export files.

All jobs use the file source with a fixed schema and ``trigger(availableNow)``:
each run processes whatever arrived since the last run and stops. Progress and
output lie under the cluster's shared checkpoint folder, by a run id that follows
from the job and its folders unless the caller names one, so the next call goes on
where the last one stopped. A batch may be applied again after a failure; every
sink writes it to a place of its own batch, by overwriting, so rows count once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upkeep.session import scratch_path

# Partition column that names the run and micro-batch a stored row came with.
BATCH = "feed_batch"
# Schema of the binary file source, of which only the path is read.
LISTING = "path string, modificationTime timestamp, length long, content binary"


def _run(query_builder, spark: SparkSession, name: str, run_id: str | None, *folders: str) -> str:
    rid = run_id or hashlib.sha1("\n".join((name, *folders)).encode()).hexdigest()
    ckpt = scratch_path(spark, f"stream-{name}-{rid}/checkpoint")
    out = scratch_path(spark, f"stream-{name}-{rid}/out")
    q = query_builder(ckpt, out, rid)
    q.awaitTermination()
    return out


def _replace_batch(df: DataFrame, target: str, batch: str, partition_by=()) -> None:
    """Write ``df`` as batch ``batch`` of ``target``, replacing an earlier try of it."""
    df.withColumn(BATCH, F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
      .partitionBy(BATCH, *partition_by).parquet(target)


def daily_volume(spark: SparkSession, source_dir: str, schema: str, ts_col: str = "ts",
                 glob: str = "*.parquet", run_id: str | None = None) -> DataFrame:
    """Requests per event-time day, late rows included: state is one counter per
    day. Each micro-batch rewrites the running totals (complete mode), so the output
    table always holds every day and a repeated batch changes nothing."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source_dir)
    agg = stream.groupBy(F.window(ts_col, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n_requests"))

    def build(ckpt, out, _rid):
        def sink(batch: DataFrame, _epoch: int):
            batch.select(F.col("w.start").alias("day_start"), "n_requests").write.mode("overwrite").parquet(out)
        return agg.writeStream.outputMode("complete").option("checkpointLocation", ckpt) \
                  .foreachBatch(sink).trigger(availableNow=True).start()

    out = _run(build, spark, "daily-volume", run_id, source_dir, glob)
    return spark.read.parquet(out)


# Partition column of a row's key: stored keys are looked up by bucket.
BUCKET = "feed_bucket"


def dedup_feed(spark: SparkSession, source_dir: str, schema: str, key: str, ts_col: str,
               glob: str = "*.parquet", run_id: str | None = None, buckets: int = 64) -> DataFrame:
    """Feed without repeated keys, however late a row comes: within a batch the row
    with the earliest time stays (the smallest other columns on ties), and a key that
    an earlier batch stored is dropped by an anti join on the stored keys. Rows with
    a null key count as one key.

    Stored rows are partitioned by ``buckets`` hash buckets of their key, and a batch
    reads the keys of the buckets its own keys fall into only: a small late file costs a
    few buckets, not the store. ``buckets`` must stay the same for a run id."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source_dir)
    columns = stream.columns
    stored = T.StructType([f for f in stream.schema.fields if f.name == key] + [T.StructField(BUCKET, T.IntegerType()), T.StructField(BATCH, T.StringType())])

    def build(ckpt, out, rid):
        def sink(batch: DataFrame, epoch: int):
            rank = F.struct(ts_col, *[c for c in columns if c not in (key, ts_col)])
            one = batch.groupBy(key).agg(F.min(rank).alias("_r")).select(key, "_r.*") \
                       .withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            if epoch > 0:
                touched = [r[0] for r in one.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
                seen = spark.read.schema(stored).parquet(out).where(F.col(BUCKET).isin(touched) & (F.col(BATCH) != f"{rid}-{epoch}")) \
                            .select(F.col(key).alias("_seen"))
                one = one.join(seen, F.col(key).eqNullSafe(F.col("_seen")), "left_anti")
            _replace_batch(one.select(*columns, BUCKET), out, f"{rid}-{epoch}", [BUCKET])
        return stream.writeStream.option("checkpointLocation", ckpt).foreachBatch(sink) \
                     .trigger(availableNow=True).start()

    out = _run(build, spark, "dedup-feed", run_id, source_dir, glob, key)
    return spark.read.schema(stream.schema).parquet(out).select(*columns)


def export_ingest(spark: SparkSession, source_dir: str, transform, target: str, run_id: str | None = None, partition_by: str | None = "month_key"):
    """New CSV exports in ``source_dir`` -> ``transform(grid_batch)`` -> added to the
    canonical table ``target``, partitioned by ``feed_batch`` and month.
    ``transform`` receives (file, row_no, cells) rows of whole new files."""
    from upkeep.sources.csv_scan import CSV_GLOB
    from upkeep.sources.raw_grid import read_csv_grid
    listing = spark.readStream.format("binaryFile").schema(LISTING).option("pathGlobFilter", CSV_GLOB).load(source_dir).select("path")

    def build(ckpt, _out, rid):
        def sink(batch: DataFrame, epoch: int):
            # the batch's file names: a listing the driver holds anyway
            paths = [r.path for r in batch.select("path").collect()]
            if paths:
                grid = read_csv_grid(spark, paths, glob="*")
                _replace_batch(transform(grid), target, f"{rid}-{epoch}", [partition_by] if partition_by else [])
        return listing.writeStream.option("checkpointLocation", ckpt).foreachBatch(sink) \
                      .trigger(availableNow=True).start()

    _run(build, spark, "export-ingest", run_id, source_dir, target)
    return spark.read.parquet(target)
