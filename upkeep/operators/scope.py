"""Row scopes: month and building access filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.functions import attach_one_row

from upkeep.functions import normalize_building
from upkeep.session import materialize


def month_scope(df: DataFrame, month: str, col: str = "month_key") -> DataFrame:
    """One ``YYYY-MM`` month, or ``ALL`` = every row with a month. On a table
    written with ``partitionBy('month_key')`` this prunes partitions."""
    if str(month).strip().upper() == "ALL":
        return df.where(F.col(col).isNotNull())
    return df.where(F.col(col) == str(month).strip())


def building_scope(df: DataFrame, scope: DataFrame, user_id, location_col: str = "location",
                   user_col: str = "user_id", building_col: str = "building") -> DataFrame:
    """Keep rows whose normalised building is allowed for ``user_id``; a user
    with no scope rows is unrestricted. Location texts are normalised once each, not
    once a row; those that are allowed (written, so the planner knows how few they are)
    are joined on, and a one-row count tells whether the user has any scope."""
    allowed = scope.where(F.col(user_col) == F.lit(user_id)) \
                   .select(normalize_building(building_col).alias("_bld")).distinct()
    places = df.select(F.col(location_col).alias("_place")).distinct().withColumn("_bld", normalize_building("_place"))
    places = materialize(places.join(allowed, "_bld").select("_place", F.lit(True).alias("_in")))
    tagged = df.join(places, df[location_col].eqNullSafe(places["_place"]), "left")
    n = allowed.agg(F.count(F.lit(1)).alias("_allowed"))
    return attach_one_row(tagged, n).where(F.col("_in") | (F.col("_allowed") == 0)).drop("_place", "_in", "_allowed")
