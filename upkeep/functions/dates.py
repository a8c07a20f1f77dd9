"""Date parsing, month keys and asset age arithmetic."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from upkeep.functions._col import col
from upkeep.functions.text import strip_ws
from upkeep import params as P

__all__ = ["month_key", "parse_date", "month_from_file_name", "next_month_start",
           "age_months_from_date", "age_months_from_year", "age_years",
           "book_value", "life_months", "DATE_FORMATS", "MONTH_NAMES"]

# ---- fixed values ----------------------------------------------------------
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july",
               "august", "september", "october", "november", "december")
# Formats tried in order by the lenient parser.
DATE_FORMATS = ("M/d/yyyy", "yyyy-MM-dd", "M/d/yy", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm",
                "M/d/yyyy h:mm:ss a", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy")
# ---------------------------------------------------------------------------


def month_key(c) -> Column:
    """``YYYY-MM`` of a date/timestamp; null stays null (never the text 'NaT')."""
    return F.date_format(col(c), "yyyy-MM")


def parse_date(c, formats=DATE_FORMATS, stripped: bool = False) -> Column:
    """Lenient date parse: first format that fits, else null.

    Blank text is null without trying formats, and the two common shapes go
    straight to their format: a failed parse costs an exception inside the
    formatter, so routing by a cheap shape test keeps the per-row cost low
    (results are the same as trying every format in order)."""
    s = col(c).cast("string") if stripped else strip_ws(col(c).cast("string"))
    full = F.coalesce(*[F.try_to_date(s, f) for f in formats])
    if tuple(formats) != DATE_FORMATS:
        return full
    return (F.when(s.isNull() | (s == ""), F.lit(None).cast("date"))
            .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(s, "M/d/yyyy"))
            .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))
            .otherwise(full))


def month_from_file_name(c, default_year: int = P.DEFAULT_FILE_YEAR, underscore_boundary: bool = False) -> Column:
    """Month word in a file name (+ optional 20xx year, else ``default_year``) -> ``YYYY-MM``.

    A word boundary treats '_' as a word character, so ``May_Report.csv`` has no
    month (as in the source cleaner); ``underscore_boundary=True`` also accepts
    '_' (and other non-letters) around the month word."""
    name = col(c)
    words = "|".join(MONTH_NAMES)
    pat = (r"(?i)(?:^|[_\W])(" + words + r")(?:$|[_\W])") if underscore_boundary else (r"(?i)\b(" + words + r")\b")
    word = F.lower(F.regexp_extract(name, pat, 1))
    kv = []
    for i, m in enumerate(MONTH_NAMES, start=1):
        kv += [F.lit(m), F.lit(f"{i:02d}")]
    mm = F.element_at(F.create_map(*kv), word)
    ypat = r"(?:^|[_\W])(20\d{2})(?:$|[_\W])" if underscore_boundary else r"\b(20\d{2})\b"
    yr = F.regexp_extract(name, ypat, 1)
    yr = F.when(yr == "", F.lit(str(default_year))).otherwise(yr)
    return F.when(word != "", F.concat(yr, F.lit("-"), mm))


def next_month_start(month_key_col) -> Column:
    """Exclusive upper bound of a ``YYYY-MM`` month."""
    return F.add_months(F.try_to_date(F.concat(col(month_key_col), F.lit("-01")), "yyyy-MM-dd"), 1)


def _as_of(as_of) -> Column:
    if isinstance(as_of, (_dt.date, str)):
        return F.lit(str(as_of)).cast("date")
    return col(as_of)


def age_months_from_date(d, as_of) -> Column:
    """Whole months since a date (one less when the day has not come yet), floor 0."""
    ref = _as_of(as_of)
    dd = col(d).cast("date")
    m = (F.year(ref) - F.year(dd)) * 12 + (F.month(ref) - F.month(dd)) \
        - F.when(F.dayofmonth(ref) < F.dayofmonth(dd), 1).otherwise(0)
    return F.when(dd.isNotNull(), F.greatest(F.lit(0), m))


def age_months_from_year(y, as_of) -> Column:
    """Months since 1 July of a purchase year, floor 0."""
    ref = _as_of(as_of)
    m = (F.year(ref) - col(y)) * 12 + (F.month(ref) - 7)
    return F.when(col(y).isNotNull(), F.greatest(F.lit(0), m))


def age_years(d, as_of) -> Column:
    return F.datediff(_as_of(as_of), col(d).cast("date")) / F.lit(365.0)


def life_months(years) -> Column:
    return col(years) * F.lit(12.0)


def book_value(cost, age_m, life_m, salvage_pct: float = P.SALVAGE_PCT) -> Column:
    """Straight-line value by month, floored at the salvage share of cost."""
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(age_m) / col(life_m)))
    return F.greatest(col(cost) * F.lit(salvage_pct), col(cost) * (F.lit(1.0) - ratio))
