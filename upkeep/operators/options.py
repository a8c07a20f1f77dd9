"""Selector options and small report counters (months, buildings, categories,
footer counts, page size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep import params as P
from upkeep.functions import normalize_building, strip_ws


def month_options(*frames: DataFrame) -> DataFrame:
    """Distinct non-null month keys over the frames (sorted by callers)."""
    u = None
    for f in frames:
        m = f.where(F.col("month_key").isNotNull()).select("month_key")
        u = m if u is None else u.union(m)
    return u.distinct()


def building_options(*frames_and_cols) -> DataFrame:
    """Distinct non-blank normalised buildings over (frame, location column) pairs."""
    u = None
    for f, c in frames_and_cols:
        b = f.select(normalize_building(c).alias("building")).where(F.col("building") != "")
        u = b if u is None else u.union(b)
    return u.distinct()


def category_options(df: DataFrame, col: str = "category") -> DataFrame:
    return df.select(strip_ws(F.col(col)).alias(col)).where(F.col(col).isNotNull() & (F.col(col) != "")).distinct()


def latest_month(df: DataFrame) -> DataFrame:
    return df.where(F.col("month_key").isNotNull()).agg(F.max("month_key").alias("latest_month"))


def page_size(value) -> int | None:
    """Rows of a page; ``None`` stands for the whole report (``'all'``). Values
    that are no number give the default, numbers below one give one."""
    text = str(value if value is not None else "").strip().lower()
    if text == "all":
        return None
    return max(1, int(text)) if text.lstrip("+-").isdigit() else P.PAGE_SIZE_DEFAULT


def page(df: DataFrame, order_cols, page_no: int = 0, size=None) -> DataFrame:
    """One page of a sorted report (sorting is the feature; the page is a window on
    it); the whole sorted report when ``size`` is ``'all'``."""
    n = page_size(size)
    out = df.orderBy(*order_cols)
    return out if n is None else out.offset(max(0, int(page_no)) * n).limit(n)
