"""Replacement table: per-asset repair spend, price, depreciation and status.

Order of operations follows the report's contract: category / building /
repair-count-bin filters run on repair rows *before* the rollup (they change
sums and first values); status / text / id filters run after it.
One shuffle on the asset id does the rollup; attributes that depend only on
the id (name, category, price) are joined after the rollup, on one row per
asset instead of one row per repair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.functions import (combine_status, id_contains, life_status, normalize_building,
                              regex_search, replace_status)
from upkeep.operators.rollup import asset_rollup, ids_in_bin
from upkeep.params import Params


def replacement_rollup(rep: DataFrame, *, attrs: DataFrame | None = None,
                       locations: DataFrame | None = None, location_key: str = "suppkey",
                       id_col: str = "equip_id", category: str | None = None,
                       building: str | None = None, repair_count_bin: str | None = None) -> DataFrame:
    """Row filters, then one row per asset with first attributes and cost sums.

    ``rep`` holds repair rows (id, parts, labor, row_ord and either a ``location``
    column or ``location_key``). ``attrs`` holds per-id attributes (equipment,
    category, new_price, ...). ``locations`` maps ``location_key`` -> location.
    """
    rows = rep
    if building:
        if "location" not in rows.columns:
            rows = rows.join(locations, rows[location_key] == locations[locations.columns[0]], "left") \
                       .drop(locations.columns[0])
        rows = rows.where(normalize_building("location") == building)
    if category:
        if "category" not in rows.columns:
            rows = rows.join(attrs.select(id_col, "category"), id_col, "left")
        rows = rows.where(F.col("category") == category)
    if repair_count_bin:
        rows = rows.join(ids_in_bin(rows, repair_count_bin, id_col), id_col, "left_semi")
    # the building is the first row's, also where that row has none
    if "location" in rows.columns:
        place = ["location"]
    elif locations is not None and location_key in rows.columns:
        place = [location_key]
    else:
        place = []
    firsts = [c for c in ("equipment", "new_price", "price_source", "category") if c in rows.columns]
    roll = asset_rollup(rows, id_col=id_col, firsts=firsts, sums=("parts", "labor"), row_firsts=place)
    if "location" not in roll.columns and locations is not None:
        k = locations.columns[0]
        roll = roll.join(locations, roll[location_key] == locations[k], "left").drop(k, location_key)
    if attrs is not None:
        keep = [id_col] + [c for c in attrs.columns if c != id_col and c not in roll.columns]
        roll = roll.join(attrs.select(*keep), id_col, "left")
    if "location" not in roll.columns:
        return roll.withColumn("building", F.lit(""))
    return roll.withColumn("building", normalize_building("location"))


def replacement_status(roll: DataFrame, params: Params = Params(), *, age_col: str | None = None,
                       life_col: str | None = None, status: str | None = None,
                       equipment_substr: str | None = None, id_substr: str | None = None,
                       id_col: str = "equip_id") -> DataFrame:
    """Cost totals and the combined Replace / Monitor / Good status, then the
    post-rollup filters."""
    out = roll.withColumn("total_cost", F.col("labor") + F.col("parts")) \
              .withColumn("repair_status", replace_status("labor", "parts", "new_price",
                                                          params.replace_ratio, params.monitor_ratio))
    if age_col and life_col:
        out = out.withColumn("life_status", life_status(age_col, life_col, params.life_replace_ratio,
                                                        params.life_monitor_ratio))
        out = out.withColumn("status", combine_status("repair_status", "life_status"))
    else:
        out = out.withColumn("status", combine_status("repair_status"))
    if status and status != "All":
        out = out.where(F.col("status") == status)
    if equipment_substr:
        out = out.where(regex_search("equipment", equipment_substr))
    if id_substr:
        out = out.where(id_contains(id_col, id_substr))
    return out
