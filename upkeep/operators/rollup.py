"""Per-asset rollups (first-row-wins attributes plus cost sums)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.functions import norm_equip_id, repair_count_bin


def first_non_null(c: str, order_col: str = "row_ord") -> Column:
    """Value of ``c`` on the earliest row (by a total order key) where it is not null.

    ``min_by`` is a declarative aggregate with a partial (map-side) phase, so a
    hot id still reduces to one small buffer per task before the shuffle."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_col)))


def last_non_null(c: str, order_col: str = "row_ord") -> Column:
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_col)))


def drop_blank_ids(df: DataFrame, id_col: str = "equip_id") -> DataFrame:
    """Rows with a blank normalised id are out of every per-asset rollup."""
    dt = dict(df.dtypes)[id_col]
    if dt == "string":
        return df.where(norm_equip_id(id_col) != "")
    return df.where(F.col(id_col).isNotNull())


def asset_rollup(df: DataFrame, id_col: str = "equip_id", order_col: str = "row_ord",
                 firsts: Sequence[str] = (), sums: Sequence[str] = ("parts", "labor"),
                 count_col: str | None = "n_rows", row_firsts: Sequence[str] = ()) -> DataFrame:
    """One row per asset: first non-null value of each ``firsts`` column in row
    order, the first row's value of each ``row_firsts`` column (null included),
    sums of ``sums`` and the row count. Blank ids are dropped first."""
    aggs = [first_non_null(c, order_col).alias(c) for c in firsts]
    aggs += [F.min_by(F.col(c), F.col(order_col)).alias(c) for c in row_firsts]
    aggs += [F.sum(c).alias(c) for c in sums]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    return drop_blank_ids(df, id_col).groupBy(id_col).agg(*aggs)


def repair_count_mix(df: DataFrame, id_col: str = "equip_id") -> DataFrame:
    """Assets per repair-count bin (rows per id, blank ids out)."""
    per_id = drop_blank_ids(df, id_col).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy(repair_count_bin("n").alias("bin")).agg(F.count(F.lit(1)).alias("n_assets"))


def ids_in_bin(df: DataFrame, bin_label: str, id_col: str = "equip_id") -> DataFrame:
    """Ids whose repair-row count falls in ``bin_label`` (for a left-semi filter)."""
    per_id = drop_blank_ids(df, id_col).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return per_id.where(repair_count_bin("n") == bin_label).select(id_col)


def asset_snapshot(df: DataFrame, equip_id, id_col: str = "equip_id", firsts=("equipment", "location"),
                   sums=("parts", "labor")) -> DataFrame:
    """One asset's first attributes and cost sums (filter pushed to the scan)."""
    present = [c for c in firsts if c in df.columns]
    return asset_rollup(df.where(F.col(id_col) == F.lit(equip_id)), id_col, firsts=present, sums=sums)


def calendar_year(df: DataFrame, year: int, col: str = "month_key") -> DataFrame:
    """Rows whose month key falls in ``year``."""
    return df.where(F.substring(F.col(col), 1, 4) == str(int(year)))
