"""Equipment category resolution from id lookups and name rules.

Two orders exist on purpose:
* ``resolve_category`` (repair / service rows): type map -> equipment summary
  (ignoring 'Other') -> name rules -> 'Other';
* ``equipment_row_category`` (equipment list rows): the row's own type ->
  type map -> name rules -> 'Other'.
Lookup tables are one row per id, built with first/last-row-wins aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.functions import norm_equip_id, strip_ws
from upkeep.functions.keywords import with_equip_type_from_name


def _nonblank(c):
    v = strip_ws(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.when(v != "", v)


def type_map(rows: DataFrame, id_col: str = "equip_id", type_col: str = "equip_type",
             order_col: str = "row_ord", last: bool = False) -> DataFrame:
    """id -> type, first (or last) non-blank row per id."""
    r = rows.select(F.col(id_col).alias("equip_id"), _nonblank(type_col).alias("equip_type"), order_col) \
            .where(F.col("equip_type").isNotNull() & F.col("equip_id").isNotNull())
    agg = F.max_by if last else F.min_by
    return r.groupBy("equip_id").agg(agg("equip_type", order_col).alias("equip_type"))


def merge_type_lookups(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """id -> type where ``primary`` wins and ``secondary`` fills ids it lacks."""
    p = primary.select("equip_id", F.col("equip_type").alias("_p"))
    s = secondary.select("equip_id", F.col("equip_type").alias("_s"))
    return p.join(s, "equip_id", "full_outer").select("equip_id", F.coalesce("_p", "_s").alias("equip_type"))


def resolve_category(rows: DataFrame, name_col: str, tmap: DataFrame | None, summary: DataFrame | None,
                     id_col: str = "equip_id", out: str = "category",
                     default: str | None = "Other") -> DataFrame:
    """Category per row: type map, then summary type unless 'Other', then the
    name rules (computed once per distinct name), then ``default``."""
    r = rows
    if tmap is not None:
        r = r.join(tmap.select(F.col("equip_id").alias(id_col), F.col("equip_type").alias("_tm")), id_col, "left")
    else:
        r = r.withColumn("_tm", F.lit(None).cast("string"))
    if summary is not None:
        r = r.join(summary.select(F.col("equip_id").alias(id_col), F.col("equip_type").alias("_sm")), id_col, "left")
    else:
        r = r.withColumn("_sm", F.lit(None).cast("string"))
    names = with_equip_type_from_name(r.select(name_col).distinct(), name_col, "_nm")
    r = r.join(names, r[name_col].eqNullSafe(names[name_col]), "left").drop(names[name_col])
    sm = _nonblank("_sm")
    cat = F.coalesce(_nonblank("_tm"), F.when(sm != "Other", sm), _nonblank("_nm"), F.lit(default))
    return r.withColumn(out, cat.cast("string")).drop("_tm", "_sm", "_nm")


def equipment_row_category(rows: DataFrame, name_col: str, type_col: str, tmap: DataFrame | None,
                           id_col: str = "equip_id", out: str = "category") -> DataFrame:
    r = rows
    if tmap is not None:
        r = r.join(tmap.select(F.col("equip_id").alias(id_col), F.col("equip_type").alias("_tm")), id_col, "left")
    else:
        r = r.withColumn("_tm", F.lit(None).cast("string"))
    names = with_equip_type_from_name(r.select(name_col).distinct(), name_col, "_nm")
    r = r.join(names, r[name_col].eqNullSafe(names[name_col]), "left").drop(names[name_col])
    cat = F.coalesce(_nonblank(type_col), _nonblank("_tm"), _nonblank("_nm"), F.lit("Other"))
    return r.withColumn(out, cat).drop("_tm", "_nm")


def normalize_ids(df: DataFrame, raw_col: str, norm_col: str = "equip_id_norm") -> DataFrame:
    """Add the normalised id next to the raw one ('' when the raw column is absent)."""
    if raw_col in df.columns:
        return df.withColumn(norm_col, norm_equip_id(raw_col))
    return df.withColumn(norm_col, F.lit(""))
