"""Spark session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from upkeep import params as P

# Session settings every job relies on. AQE re-plans joins from runtime sizes
# (sort-merge -> broadcast when a side turns out small), coalesces tiny shuffle
# partitions and splits skewed ones; dates are compared in UTC.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Explicit broadcasts in this package are only placed on tables whose size
    # is bounded by a parameter (calendar, rule tables, nation); everything
    # else is left to the planner, which checks sizes against this threshold.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "upkeep", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the package's settings applied."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in conf.items():
        if not k.startswith("spark.ui") and not k.startswith("spark.driver"):
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf of an already running session
                pass
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the session has none (local tests) is a private folder created
    and registered; on a cluster the configured shared folder is always used.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext  # absent under Spark Connect
    except Exception:  # noqa: BLE001
        sc = None
    if not d and sc is not None and hasattr(sc, "getCheckpointDir"):
        d = sc.getCheckpointDir()
    if not d:
        d = tempfile.mkdtemp(prefix="upkeep-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - some sessions reject core confs at run time
            pass
    if sc is not None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def compiled(spark: SparkSession):
    """HotSpot compiles no method above 8,000 bytes of bytecode, so a stage that parses many
    columns in one generated method would be interpreted, row by row. Inside this context
    such a stage is run by its operators, whose expressions are cut into small methods."""
    return _set(spark, "spark.sql.codegen.hugeMethodLimit", "8000")


def unshuffled(spark: SparkSession):
    """Shuffle files of a write inside this context go when it ends: what is written is read
    from its files, and the shuffles would else stay on disk until the driver collects garbage."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def packed(spark: SparkSession):
    """Tables written inside this context, of as many rows as the input, take a fifth less disk."""
    return _set(spark, "spark.sql.parquet.compression.codec", "zstd")


def materialize(df):
    """Compute a reused intermediate result once: written as Parquet to the shared
    folder and read back, so lineage is cut, later reads are pruned to their columns
    and a lost executor costs nothing but a re-read."""
    path = scratch_path(df.sparkSession, f"materialized-{uuid.uuid4().hex}")
    with compiled(df.sparkSession), unshuffled(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHARED: dict[tuple, object] = {}


def shared(spark: SparkSession, name: str, sources: list[str], build):
    """``materialize(build())``, once for the files of ``sources`` as they are now: queries
    of a session that need the same intermediate table read one copy. The key holds every
    source file's path, length and modification time (a listing, the files aren't read), so
    changed sources make a new table; a table whose folder is gone is made again."""
    listing = [r for path in sources for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
               .select("path", "length", "modificationTime").collect()]
    key = (spark.sparkContext.applicationId, name, tuple(sorted(map(str, listing))))
    df = _SHARED.get(key)
    if df is not None:
        try:
            df.limit(1).count()
            return df
        except Exception:  # noqa: BLE001 - the folder was cleared
            pass
    _SHARED[key] = df = materialize(build())
    return df


def small(df, rows: int = P.BROADCAST_ROWS):
    """A dimension table, written; a broadcast is hinted while it has at most ``rows`` rows,
    beyond that the planner decides by its size."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= rows else df
