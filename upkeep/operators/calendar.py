"""Business-day calendar dimension and the inclusive business-day span.

Weekdays are counted in closed form, for any date. Only holidays need a table:
the calendar is one row per day of the holiday range (a parameter, about 13,000
rows), so its size is bounded by configuration, not by data, and it is joined by
broadcast. Each row carries the holidays so far; a date outside the range is
looked up at the nearest end, where the running count no longer changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upkeep.functions._col import col
from upkeep.params import Params

# ---- fixed values: US federal holiday rules --------------------------------
# (month, day) holidays moved to the nearest weekday (Sat -> Fri, Sun -> Mon):
FIXED_DATE_HOLIDAYS = ((1, 1), (7, 4), (11, 11), (12, 25))
JUNETEENTH = (6, 19)                  # observed from 2021-06-18 on
JUNETEENTH_FIRST = "2021-06-18"
# (month, weekday, first day of the 7-day window) for nth-weekday holidays;
# weekday 0 = Monday: MLK day, Presidents day, Memorial day (last Monday),
# Labor day, Columbus day, Thanksgiving (4th Thursday).
NTH_WEEKDAY_HOLIDAYS = ((1, 0, 15), (2, 0, 15), (5, 0, 25), (9, 0, 1), (10, 0, 8), (11, 3, 22))
# ---------------------------------------------------------------------------


def _observed(d: Column, month: int, day: int) -> Column:
    wd = F.weekday(d)  # 0 = Monday
    same = (F.month(d) == month) & (F.dayofmonth(d) == day) & (wd < 5)
    fri = (wd == 4) & (F.month(F.date_add(d, 1)) == month) & (F.dayofmonth(F.date_add(d, 1)) == day)
    mon = (wd == 0) & (F.month(F.date_sub(d, 1)) == month) & (F.dayofmonth(F.date_sub(d, 1)) == day)
    return same | fri | mon


def is_federal_holiday(d, start: str, end: str) -> Column:
    """Observed US federal holiday inside [start, end]."""
    d = col(d)
    wd = F.weekday(d)
    hit = F.lit(False)
    for m, dd in FIXED_DATE_HOLIDAYS:
        hit = hit | _observed(d, m, dd)
    hit = hit | (_observed(d, *JUNETEENTH) & (d >= F.lit(JUNETEENTH_FIRST).cast("date")))
    for m, w, first in NTH_WEEKDAY_HOLIDAYS:
        hit = hit | ((F.month(d) == m) & (wd == w) & F.dayofmonth(d).between(first, first + 6))
    in_range = d.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return hit & in_range


def business_calendar(spark: SparkSession, params: Params = Params()) -> DataFrame:
    """(cal_date, is_bd, cum_bd, is_hol, cum_hol) from the day before the holiday
    range to its end; ``is_hol`` marks holidays that fall on weekdays."""
    days = spark.range(1).select(F.explode(F.sequence(
        F.date_sub(F.lit(params.holiday_start).cast("date"), 1), F.lit(params.holiday_end).cast("date"),
        F.expr("INTERVAL 1 DAY"))).alias("cal_date"))
    weekday = F.weekday("cal_date") < 5
    holiday = is_federal_holiday("cal_date", params.holiday_start, params.holiday_end)
    # Global running sums over a parameter-bounded table: one task is fine.
    w = Window.orderBy("cal_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.withColumn("is_bd", (weekday & ~holiday).cast("int")) \
               .withColumn("is_hol", (weekday & holiday).cast("int")) \
               .withColumn("cum_bd", F.sum("is_bd").over(w)).withColumn("cum_hol", F.sum("is_hol").over(w))


def _weekdays_upto(d: Column) -> Column:
    """Mondays to Fridays from 1969-12-29 (a Monday) to ``d``, negative before it."""
    n = F.unix_date(d) + 3
    week = F.floor(n / 7)
    return week * 5 + F.least(n - week * 7 + 1, F.lit(5))


def with_business_days(df: DataFrame, start: str, end: str, out: str, calendar: DataFrame,
                       params: Params = Params()) -> DataFrame:
    """Add ``out`` = inclusive Mon-Fri business days from ``start`` to ``end``,
    federal holidays of the holiday range out; same day counts 1; null when either
    date is null or end precedes start. ``calendar`` is ``business_calendar`` of the
    same ``params``; dates may lie anywhere."""
    lo = F.date_sub(F.lit(params.holiday_start).cast("date"), 1)
    hi = F.lit(params.holiday_end).cast("date")
    ca = F.broadcast(calendar.select(F.col("cal_date").alias("_a_d"), F.col("is_hol").alias("_a_hol"),
                                     F.col("cum_hol").alias("_a_cum")))
    cb = F.broadcast(calendar.select(F.col("cal_date").alias("_b_d"), F.col("cum_hol").alias("_b_cum")))
    a, b = F.col(start).cast("date"), F.col(end).cast("date")

    def within(d):
        return F.when(d.isNotNull(), F.greatest(F.least(d, hi), lo))

    j = df.join(ca, within(a) == F.col("_a_d"), "left").join(cb, within(b) == F.col("_b_d"), "left")
    a_hol = F.when(a.between(lo, hi), F.col("_a_hol")).otherwise(F.lit(0))
    weekdays = _weekdays_upto(b) - _weekdays_upto(a) + (F.weekday(a) < 5).cast("int")
    span = weekdays - (F.col("_b_cum") - F.col("_a_cum") + a_hol)
    val = (F.when(a.isNull() | b.isNull() | (b < a), F.lit(None))
           .when(a == b, F.lit(1.0))
           .otherwise(span.cast("double")))
    return j.withColumn(out, val).drop("_a_d", "_a_hol", "_a_cum", "_b_d", "_b_cum")
