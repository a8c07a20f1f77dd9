"""Overview report: every KPI and chart dataset for one scope, and drill-down
from a clicked chart element to the filters of the other reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.functions import attach_one_row
from upkeep.operators import metrics as M
from upkeep.operators.calendar import business_calendar
from upkeep.operators.rollup import repair_count_mix
from upkeep.operators.scope import building_scope, month_scope
from upkeep.operators.service_scope import done_with_turnaround, prepare_service_for_display
from upkeep.params import Params
from upkeep.session import materialize


def overview(spark: SparkSession, month: str, req: DataFrame, svc_all: DataFrame, rep: DataFrame,
             equipment: DataFrame, params: Params = Params(), capacity_overrides: DataFrame | None = None,
             scope: DataFrame | None = None, user_id=None) -> dict[str, DataFrame]:
    """Datasets of the overview for ``month`` ('ALL' or 'YYYY-MM').

    Inputs are scoped once (month, then building); the scoped repairs and the displayed
    service rows are written because most datasets read them. The completion catalogue of
    the all-months status rule is the unscoped service table, written before, since
    scopes and rules read it many times."""
    all_months = str(month).strip().upper() == "ALL"
    catalog = materialize(svc_all.where(F.col("month_key").isNotNull())) if all_months else svc_all
    r, s, q = month_scope(rep, month), month_scope(catalog, month), month_scope(req, month)
    if scope is not None:
        r = building_scope(r, scope, user_id)
        s = building_scope(s, scope, user_id)
        q = building_scope(q, scope, user_id) if "location" in q.columns else q
    r = materialize(r)
    s = materialize(prepare_service_for_display(s, month, catalog=catalog))
    cal = business_calendar(spark, params)
    done = done_with_turnaround(s, cal, params)
    out = {
        "kpis": M.kpi_row(q, s, r),
        "hours_by_category": M.hours_by_category(r, params=params),
        "completion_rate": M.completion_rate(s),
        "avg_repair_hours": M.avg_repair_hours(r),
        "turnaround_by_category": M.turnaround_by_category(done, params=params),
        "availability_by_category": M.availability_by_category(done, equipment, params.base_avail_days),
        "repair_count_mix": repair_count_mix(r),
    }
    if "location" in r.columns:
        out["hours_by_building"] = M.hours_by_building(r)
    if all_months:
        out["request_volume"] = M.request_volume_by_month(q)
        out["staff_capacity"] = M.staff_capacity_all(r, M.active_months(q, s, r), params)
        out["parts_budget"] = M.parts_budget(r, annual=True, params=params)
    else:
        out["request_calendar"] = M.request_calendar(q, month, params.week_starts_on)
        ov = capacity_overrides if capacity_overrides is not None else M.capacity_table(spark, {}, params)
        chosen = spark.range(1).select(F.lit(month).alias("month_key"))
        out["staff_capacity"] = M.staff_capacity_by_month(r, ov, params, chosen)
        out["parts_budget"] = M.parts_budget(r, annual=False, params=params)
    out["footer"] = footer(r, s)
    return out


def footer(rep: DataFrame, svc: DataFrame) -> DataFrame:
    """One row for the report footer: repair records, distinct assets, service orders
    and the latest service month."""
    a = rep.agg(F.count(F.lit(1)).alias("repair_records"), F.countDistinct("equip_id").alias("assets"))
    b = svc.agg(F.count(F.lit(1)).alias("service_orders"), F.max("month_key").alias("latest_month"))
    return attach_one_row(a, b)


def drill_down(chart: str, value: str, month: str | None = None) -> dict:
    """Filters for the linked report when a chart element is clicked. A building
    filter is a column expression over the clicked value."""
    v = str(value or "").strip()
    if chart == "hours_by_category":
        return {"report": "replacement", "category": v}
    if chart == "hours_by_building":
        from upkeep.functions.text import resolve_building_filter
        return {"report": "replacement", "building": resolve_building_filter(F.lit(v))}
    if chart == "repair_count_mix":
        return {"report": "replacement", "repair_count_bin": v}
    if chart == "request_calendar":
        return {"report": "requests", "month": month, "day": v}
    if chart in ("turnaround_by_category", "availability_by_category"):
        return {"report": "orders", "category": v}
    return {}
