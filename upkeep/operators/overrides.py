"""Manual useful-life extensions: load, merge (upsert / delete) and audit feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.functions import norm_equip_id, strip_ws

MAX_EXTRA_MONTHS = 240.0


# Optional text columns of an override, blank when absent.
DETAIL_COLUMNS = ("note", "review_by", "updated_at")
# Column names of the stored override files and the names used here.
FILE_COLUMNS = {"equipId": "equip_id", "extraMonths": "extra_months", "extraYears": "extra_years",
                "reviewBy": "review_by", "updatedAt": "updated_at"}


def load_life_overrides(raw: DataFrame, order_col: str = "row_ord") -> DataFrame:
    """Rows (equip_id, extra_months, note, review_by, updated_at as far as present).

    Months come from ``extra_months``; only where that cell is blank from the legacy
    years x 12. Cells that are no number and non-positive values drop the row;
    values above 240 count as 240. The last row (``order_col``) per id wins. The
    stored files' own column names are read as well."""
    r = raw.withColumnsRenamed(FILE_COLUMNS)

    def cell(name):
        return F.col(name).cast("string") if name in r.columns else F.lit(None).cast("string")

    given = strip_ws(F.coalesce(cell("extra_months"), F.lit(""))) != ""
    months = F.when(given, strip_ws(cell("extra_months")).try_cast("double")) \
              .otherwise(strip_ws(cell("extra_years")).try_cast("double") * 12.0)
    r = r.withColumn("equip_id", norm_equip_id("equip_id")) \
         .withColumn("extra_months", F.when(months > MAX_EXTRA_MONTHS, F.lit(MAX_EXTRA_MONTHS)).otherwise(months)) \
         .where((F.col("equip_id") != "") & (F.col("extra_months") > 0) & ~F.isnan(months))
    others = [c for c in DETAIL_COLUMNS if c in r.columns]
    return r.groupBy("equip_id").agg(
        F.max_by(F.struct("extra_months", *others), F.col(order_col)).alias("_v")).select("equip_id", "_v.*")


def merge_overrides(base: DataFrame, changes: DataFrame, id_col: str = "equip_id",
                    order_col: str | None = None, updated_at=None) -> DataFrame:
    """Upsert ``changes`` into ``base`` by id: a change replaces the base row, one
    with no positive ``extra_months`` deletes it. Of several changes of one id the
    last by ``order_col`` counts (without one: the largest row). Months are whole
    (halves to even), at most 240; ``updated_at`` (a date text) stamps the changes.
    The result (id, extra_months, note, review_by, updated_at as far as present in
    either table) is a new table version."""
    details = [c for c in DETAIL_COLUMNS if c in base.columns or c in changes.columns
               or (c == "updated_at" and updated_at is not None)]

    def rows(df, src, stamp):
        def detail(c):
            if c == "updated_at" and stamp is not None:
                return F.lit(str(stamp)).alias(c)
            known = F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
            return strip_ws(F.coalesce(known, F.lit(""))).alias(c)
        rank = F.col(order_col) if src and order_col else F.lit(0)
        return df.select(id_col, F.struct(F.lit(src).alias("src"), rank.cast("long").alias("ord")).alias("_rank"),
                         F.struct(F.coalesce("extra_months", F.lit(0.0)).cast("double").alias("extra_months"),
                                  *[detail(c) for c in details]).alias("_v"))

    u = rows(base, 0, None).unionByName(rows(changes, 1, updated_at))
    last = u.groupBy(id_col).agg(F.max(F.struct("_rank", "_v")).alias("_m")).select(id_col, "_m._v.*")
    return last.where(F.col("extra_months") > 0) \
               .withColumn("extra_months", F.bround(F.least(F.col("extra_months"), F.lit(MAX_EXTRA_MONTHS)), 0))
