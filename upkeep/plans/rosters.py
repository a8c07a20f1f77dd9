"""Order roster (service rows with business-day turnaround) and request roster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.functions import abbreviate_building, id_contains, regex_search, strip_ws
from upkeep.operators.calendar import with_business_days


def order_roster(svc: DataFrame, calendar: DataFrame, *, category: str | None = None,
                 status_substr: str | None = None, equipment_substr: str | None = None,
                 id_substr: str | None = None) -> DataFrame:
    """One display row per (already display-prepared) service row."""
    s = svc if "category" in svc.columns else svc.withColumn("category", F.lit("Other"))
    ok = F.col("sched_date").isNotNull() & F.col("completed_date").isNotNull() & \
        (F.col("completed_date") >= F.col("sched_date"))
    s = with_business_days(s, "sched_date", "completed_date", "_bd", calendar)
    bd = F.when(ok & F.col("_bd").isNotNull(), F.col("_bd").cast("bigint").cast("string")).otherwise(F.lit(""))
    out = s.select(
        F.coalesce(F.col("equipment").cast("string"), F.lit("")).alias("equipment"),
        F.coalesce(F.col("equip_id").cast("string"), F.lit("")).alias("equip_id"),
        abbreviate_building("location").alias("building"),
        F.coalesce(F.col("category"), F.lit("")).alias("category"),
        strip_ws(F.coalesce(F.col("status"), F.lit(""))).alias("status"),
        F.coalesce(F.date_format("sched_date", "yyyy-MM-dd"), F.lit("")).alias("start_scheduled"),
        F.coalesce(F.date_format("completed_date", "yyyy-MM-dd"), F.lit("")).alias("end_completed"),
        bd.alias("business_days"))
    if category:
        out = out.where(F.col("category") == category.strip())
    if status_substr:
        out = out.where(regex_search("status", status_substr))
    if equipment_substr:
        out = out.where(regex_search("equipment", equipment_substr))
    if id_substr:
        out = out.where(id_contains("equip_id", id_substr))
    return out


def request_roster(req: DataFrame, *, day: str | int | None = None, work_order_substr: str | None = None,
                   requestor_substr: str | None = None, request_substr: str | None = None) -> DataFrame:
    """Requests filtered by day of month and text searches, newest first."""
    r = req
    if day is not None and str(day).strip():
        try:
            n = int(str(day).strip())
            r = r.where(F.dayofmonth("request_date") == n)
        except ValueError:
            pass  # a non-integer day filter is ignored
    if work_order_substr:
        r = r.where(regex_search(F.col("work_order").cast("string"), work_order_substr))
    if requestor_substr:
        r = r.where(regex_search("requestor", requestor_substr))
    if request_substr:
        r = r.where(regex_search("request", request_substr))
    out = r.select(F.coalesce(F.col("work_order").cast("string"), F.lit("")).alias("work_order"),
                   F.coalesce(F.date_format("request_date", "yyyy-MM-dd"), F.lit("")).alias("request_date"),
                   F.coalesce(F.col("requestor"), F.lit("")).alias("requestor"),
                   F.coalesce(F.col("request"), F.lit("")).alias("request"),
                   F.coalesce(F.col("assigned_to") if "assigned_to" in req.columns else F.lit(""),
                              F.lit("")).alias("assigned_to"))
    return out.orderBy(F.col("request_date").desc())
