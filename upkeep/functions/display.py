"""Display formatting (kept out of core results; applied to finished reports)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from upkeep.functions._col import col

DASH = "—"


def money(c, whole: bool = False) -> Column:
    """``$1,234.00`` (or ``$1,234`` when ``whole``); null -> dash."""
    x = col(c)
    return F.when(x.isNull(), F.lit(DASH)).otherwise(
        F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), F.format_number(F.abs(x), 0 if whole else 2)))


def months(c) -> Column:
    """``12 mo`` (rounded, halves to even), null -> dash."""
    x = col(c)
    return F.when(x.isNull(), F.lit(DASH)).otherwise(F.concat(F.bround(x, 0).cast("long").cast("string"), F.lit(" mo")))


def months_adjustment(c) -> Column:
    """``+6 mo`` for a positive extension, else a dash."""
    x = col(c)
    return F.when(x > 0, F.concat(F.lit("+"), F.bround(x, 0).cast("long").cast("string"), F.lit(" mo"))).otherwise(F.lit(DASH))


def us_date(c) -> Column:
    return F.date_format(col(c), "MM/dd/yyyy")


def iso_date(c) -> Column:
    return F.coalesce(F.date_format(col(c), "yyyy-MM-dd"), F.lit(""))
