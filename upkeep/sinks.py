"""Writers: canonical tables, report datasets and the export audit row."""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.functions import strip_html


def write_canonical(df: DataFrame, path: str, partition_by: str | None = "month_key", mode: str = "overwrite",
                    fmt: str = "parquet") -> None:
    """Cleaned table written partitioned by month (month scope then prunes files).
    Dynamic partition overwrite replaces only the months present in ``df``."""
    w = df.write.mode(mode).format(fmt)
    if partition_by and partition_by in df.columns:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    w.save(path)


def write_csv_report(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """A report as CSV with a header (valuation sheet, cleaned exports)."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).csv(path)


def export_report(df: DataFrame, path: str, *, event_type: str, username: str, user_id, role: str,
                  month_key: str, filters: dict, building_scope: list, audit_path: str) -> int:
    """Write the currently filtered rows of a report (HTML stripped from text
    columns) and append one audit row; returns the row count."""
    out = df.select(*[strip_html(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    out.write.mode("overwrite").parquet(path)
    n = df.sparkSession.read.parquet(path).count()
    spark: SparkSession = df.sparkSession
    row = [(_dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), event_type, username, str(user_id), role,
            month_key, json.dumps(filters, sort_keys=True), int(n), json.dumps(building_scope), "ok", "", "")]
    ev = spark.createDataFrame(row, "created_at timestamp, event_type string, username string, user_id string, "
                                    "role string, month_key string, filters_json string, row_count long, "
                                    "building_scope_json string, status string, error_message string, ip string")
    from upkeep.operators.audit import append_events
    append_events(ev.withColumn("id", F.expr("uuid()")), audit_path)
    return n


def output_name(source_file, month_key, suffix: str = "Repair_List_All_Work_Orders") -> Column:
    """File name of a cleaned export: the month's name where a month is known, else the
    source name without its extension, runs of other characters as one underscore."""
    month = F.date_format(F.try_to_date(F.concat(F.col(month_key), F.lit("-01")), "yyyy-MM-dd"), "MMMM")
    stem = F.regexp_replace(F.regexp_replace(F.col(source_file), r"(?<=.)\.[^./]*$", ""), r"(?U)\W+", "_")
    return F.coalesce(F.concat(month, F.lit("_" + suffix + ".csv")),
                      F.concat(F.btrim(stem, F.lit("_")), F.lit("_cleaned.csv")))
