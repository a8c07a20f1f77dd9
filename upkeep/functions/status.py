"""Replace / Monitor / Good rules and repair-count bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from upkeep.functions._col import col
from upkeep import params as P

__all__ = ["replace_status", "life_status", "combine_status", "status_rank",
           "repair_count_bin", "category_rank"]


def replace_status(labor, parts, new_price, replace_ratio: float = P.REPLACE_RATIO,
                   monitor_ratio: float = P.MONITOR_RATIO) -> Column:
    """Repair spend as a share of new price; no positive price -> Good."""
    price = F.coalesce(col(new_price).cast("double"), F.lit(0.0))
    spent = F.coalesce(col(labor).cast("double"), F.lit(0.0)) + F.coalesce(col(parts).cast("double"), F.lit(0.0))
    return (F.when(price <= 0, F.lit("Good"))
            .when(spent >= F.lit(replace_ratio) * price, F.lit("Replace"))
            .when(spent >= F.lit(monitor_ratio) * price, F.lit("Monitor"))
            .otherwise(F.lit("Good")))


def life_status(age_months, life_months_col, replace_ratio: float = P.LIFE_REPLACE_RATIO,
                monitor_ratio: float = P.LIFE_MONITOR_RATIO) -> Column:
    """Age against useful life; null when either is unknown or life <= 0."""
    a, l = col(age_months).cast("double"), col(life_months_col).cast("double")
    r = a / l
    return (F.when(a.isNull() | l.isNull() | (l <= 0), F.lit(None).cast("string"))
            .when(r >= replace_ratio, F.lit("Replace"))
            .when(r >= monitor_ratio, F.lit("Monitor"))
            .otherwise(F.lit("Good")))


def status_rank(c) -> Column:
    s = F.regexp_replace(col(c), r"^\s+|\s+$", "")
    return (F.when(s == "Replace", 2).when(s == "Monitor", 1).otherwise(0))


def combine_status(*statuses) -> Column:
    """Most urgent label among the inputs (nulls and blanks ignored; default Good)."""
    r = F.greatest(*[F.coalesce(status_rank(s), F.lit(0)) for s in statuses]) if len(statuses) > 1 \
        else F.coalesce(status_rank(statuses[0]), F.lit(0))
    return F.when(r == 2, F.lit("Replace")).when(r == 1, F.lit("Monitor")).otherwise(F.lit("Good"))


def repair_count_bin(n) -> Column:
    c = col(n)
    return (F.when(c <= 1, F.lit("1 repair")).when(c == 2, F.lit("2 repairs"))
            .when(c == 3, F.lit("3 repairs")).when(c == 4, F.lit("4 repairs"))
            .otherwise(F.lit("5+ repairs")))


def category_rank(c, order=P.CHART_CLASS_ORDER) -> Column:
    """Preferred chart position; names outside the list sort after it."""
    kv = []
    for i, name in enumerate(order):
        kv += [F.lit(name), F.lit(i)]
    return F.coalesce(F.element_at(F.create_map(*kv), col(c)), F.lit(len(order)))
