"""Plain table reads: CSV folders as all-text tables, parameterised SQL over a
CSV, first present column, and re-reading earlier cleaned outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.session import materialize
from upkeep.sources.csv_scan import CSV_GLOB, scan_csv
from upkeep.sources.raw_grid import header_name_rows, read_csv_grid


def read_csv_table(spark: SparkSession, path: str | list[str], glob: str = CSV_GLOB, skip_bad: bool = False) -> DataFrame:
    """Every CSV under ``path`` with a header row, united by column name: files may
    order their columns differently or lack some (null there). All columns are text
    in order of first appearance (file name, position); repeated and blank header
    names are made unique per file. ``source_file`` keeps the file name.

    Only the distinct header names reach the driver; a row's cell is read from the
    place its own file's header gives that name. Cells right of a file's last header
    name have no column. A file that cannot be used fails the job, or is left out
    with ``skip_bad`` (``rejected_files`` lists those)."""
    return unite_by_name(read_csv_grid(spark, path, glob, skip_bad))


def unite_by_name(grid: DataFrame) -> DataFrame:
    """``read_csv_table`` of a grid whose files have their header on the first row."""
    top = materialize(grid.where(F.col("row_no") == 0))
    heads = materialize(header_name_rows(top, top.select("file", F.lit(0).alias("header_row"))).select("file", "pos", "name"))
    order = heads.groupBy("name").agg(F.min(F.struct("file", "pos")).alias("at"))
    names = [r["name"] for r in order.orderBy("at").select("name").collect()]
    # one row a file: the place of every name in it
    ordered = F.array_sort(F.collect_list(F.struct("_k", "pos")))
    known = heads.select("file", "pos", F.array_position(F.lit(names) if names else F.array().cast("array<string>"), F.col("name")).alias("_k"))
    places = materialize(known.groupBy(F.col("file").alias("_nf")).agg(F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["_k"], x["pos"]))).alias("_m"))
                         .select("_nf", F.transform(F.sequence(F.lit(1), F.lit(max(1, len(names)))), lambda k: F.try_element_at("_m", k.cast("long"))).alias("_at")))
    rows = grid.where(F.col("row_no") > 0).join(places, F.col("file") == F.col("_nf"))
    return rows.select(*[F.get("cells", F.get("_at", F.lit(k))).alias(n) for k, n in enumerate(names)], F.col("file").alias("source_file"))


def rejected_files(spark: SparkSession, path: str | list[str], glob: str = CSV_GLOB) -> DataFrame:
    """(file, reason) of the CSV files that ``skip_bad`` leaves out."""
    return scan_csv(spark, path, glob, skip_bad=True).rejects


def csv_sql(spark: SparkSession, template: str, path: str, view: str = "csv_input", **args) -> DataFrame:
    """Run a SQL template over a CSV folder registered as a temporary view;
    values are bound as named parameters (``:name``), never spliced into text."""
    read_csv_table(spark, path).createOrReplaceTempView(view)
    return spark.sql(template, args=args or None)


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate column name present in the schema (exact names; no job)."""
    cols = set(df.columns)
    return next((c for c in candidates if c in cols), None)


def reread_cleaned(spark: SparkSession, path: str, exclude_file: str) -> DataFrame:
    """Earlier cleaned outputs except one file (e.g. the merged summary)."""
    return read_csv_table(spark, path).where(F.col("source_file") != exclude_file)
