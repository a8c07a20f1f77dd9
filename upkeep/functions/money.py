"""Money, year and repair-hour parsers (all ANSI-safe: bad input never throws)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from upkeep.functions._col import col
from upkeep.functions.text import strip_cell, strip_ws
from upkeep import params as P

__all__ = ["to_double", "parse_dollar_amount", "parse_dollar", "parse_list_cost",
           "parse_purchase_year", "parse_repair_hours", "row_mentions_found",
           "labor_cost", "total_cost", "clamp_number", "coerce_life_years"]


def to_double(c) -> Column:
    """Lenient numeric parse: invalid text -> null."""
    return strip_ws(col(c).cast("string")).try_cast("double")


def _money_text(c, stripped: bool = False) -> Column:
    s = col(c).cast("string")
    return F.translate(s if stripped else strip_ws(s), "$,", "")


def parse_dollar_amount(c) -> Column:
    """Positive amount or null: '', 'enter data' and other junk are no numbers, and
    amounts <= 0 are null too."""
    n = _money_text(strip_cell(col(c).cast("string")), stripped=True).try_cast("double")
    return F.when(n > 0, n)


def parse_dollar(c, stripped: bool = False) -> Column:
    """Amount with invalid -> 0.0; negatives kept."""
    return F.coalesce(_money_text(c, stripped).try_cast("double"), F.lit(0.0))


def parse_list_cost(c) -> Column:
    """Equipment-list cost: '$' and ',' removed, numeric or null."""
    return _money_text(c).try_cast("double")


def parse_purchase_year(c) -> Column:
    """First 19xx/20xx in the text, else a number within 1900..2100, else null."""
    s = strip_ws(col(c).cast("string"))
    hit = F.regexp_extract(s, r"(20\d{2}|19\d{2})", 1)
    num = s.try_cast("double")
    yr = F.when(num.isNotNull() & ~F.isnan(num), num.cast("long"))
    return (F.when(hit != "", hit.cast("int"))
            .when(yr.between(1900, 2100), yr.cast("int")))


def row_mentions_found(row_text) -> Column:
    low = F.lower(F.coalesce(col(row_text), F.lit("")))
    return F.contains(low, F.lit("found")) & low.rlike(r"\bfound\b")


def parse_repair_hours(details, row_text, found_hours: float = P.FOUND_HOURS,
                       blank_hours: float = P.DEFAULT_HOURS_WHEN_BLANK, mixed_numbers: bool = False,
                       stripped: bool = False) -> Column:
    """Repair duration from a free-text details cell.

    ``found`` -> found_hours; blank -> found_hours when the row mentions found,
    else blank_hours; hour words removed; ``a/b`` fraction (b = 0 -> blank_hours);
    ``'1 5'`` -> 1.5; first number with ',' as decimal point; else as blank.
    By default ``'1 1/2'`` reads as 0.5 (the fraction rule runs first, as in the
    source exports' cleaner); ``mixed_numbers=True`` reads it as 1.5.
    """
    d = col(details).cast("string")
    s = d if stripped else strip_ws(d)
    low = F.lower(s)
    blank = d.isNull() | (s == "") | (low == "nan")
    found_row = row_mentions_found(row_text)
    fallback = F.when(found_row, F.lit(float(found_hours))).otherwise(F.lit(float(blank_hours)))
    norm = low
    for w in ("hours", "hour", "hrs", "hr"):
        norm = F.replace(norm, F.lit(w), F.lit(""))
    norm = F.regexp_replace(strip_cell(norm), r"\s+", " ")
    frac = r"(\d+)\s*/\s*(\d+)"
    num_a = F.regexp_extract(norm, frac, 1).cast("double")
    num_b = F.regexp_extract(norm, frac, 2).cast("double")
    typo = r"^(\d+)\s+(\d)$"
    typo_val = F.concat(F.regexp_extract(norm, typo, 1), F.lit("."),
                        F.regexp_extract(norm, typo, 2)).cast("double")
    dotted = F.replace(norm, F.lit(","), F.lit("."))
    first_num = F.nullif(F.regexp_extract(dotted, r"(\d+\.?\d*)", 1), F.lit("")).cast("double")
    mixed = r"(\d+)\s+(\d+)\s*/\s*(\d+)"
    mixed_val = F.regexp_extract(norm, mixed, 1).cast("double") + \
        F.regexp_extract(norm, mixed, 2).cast("double") / F.regexp_extract(norm, mixed, 3).cast("double")
    out = (F.when(blank, fallback)
           .when(F.startswith(low, F.lit("found")) & low.rlike(r"^found\b"), F.lit(float(found_hours))))
    if mixed_numbers:
        out = out.when(norm.rlike(mixed) & (F.regexp_extract(norm, mixed, 3).cast("double") != 0), mixed_val)
    return (out
            .when(F.contains(low, F.lit("/")) & norm.rlike(frac),
                  F.when(num_b != 0, num_a / num_b).otherwise(F.lit(float(blank_hours))))
            .when(norm.rlike(typo), typo_val)
            .otherwise(F.coalesce(first_num, fallback)))


def labor_cost(hours, rate: float = P.LABOR_RATE_PER_HOUR) -> Column:
    """hours x rate, rounded half-to-even at cents (Python ``round``)."""
    return F.bround(col(hours) * F.lit(float(rate)), 2)


def total_cost(parts, labor) -> Column:
    return F.bround(col(parts) + col(labor), 2)


def clamp_number(c, lo, hi, default) -> Column:
    """Parse, fall back to default, clamp to [lo, hi]."""
    v = F.coalesce(to_double(c), F.lit(float(default)))
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v))


def coerce_life_years(c) -> Column:
    """Positive number of years, else null."""
    v = to_double(c)
    return F.when(v > 0, v)
