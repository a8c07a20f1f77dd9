"""Asset age, useful life, straight-line book value and the life-based status.

Fallback chain per asset (one row per id; all joins are equi joins on the id
or on a cohort key):

age   summary purchase date -> purchase-book year -> cohort median -> fleet median
life  purchase-book life -> summary depreciation years -> cohort median
      -> fleet median -> default life
cohort = keyword cohort when the asset's keyword has one (even when its median
is null, which then falls to the fleet), else equipment-type cohort.
A manual life extension (> 0 months) lengthens the life and relabels the basis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.functions import attach_one_row

from upkeep.functions import age_months_from_date, age_months_from_year, book_value
from upkeep.operators.rollup import drop_blank_ids
from upkeep.operators.stats import exact_median
from upkeep.session import materialize
from upkeep.params import Params


def equipment_meta(rows: DataFrame, order_col: str = "row_ord") -> DataFrame:
    """id -> purchase date, depreciation years and type of the **last** row of the
    equipment summary, its nulls included. Rows without an id are out."""
    last = F.max_by(F.struct("purchase_date", "depreciation_years", "equip_type"), order_col).alias("_r")
    return drop_blank_ids(rows).groupBy("equip_id").agg(last).select("equip_id", "_r.*")


def purchase_by_id(rows: DataFrame, order_col: str = "row_ord") -> DataFrame:
    """id -> year and life of the **first** purchase-book row, its nulls included."""
    first = F.min_by(F.struct("year", "life_years"), order_col).alias("_r")
    return drop_blank_ids(rows).groupBy("equip_id").agg(first).select("equip_id", "_r.*")


def purchase_cohorts(purchase: DataFrame, params: Params = Params()):
    """Cohort statistics from purchase-book rows (equip_id, keyword, equip_type,
    year, life_years): (by_keyword, by_type, fleet) with median age/life months
    and n = max(#ages, #lives)."""
    rows = drop_blank_ids(purchase).select(
        "keyword", "equip_type",
        age_months_from_year("year", params.as_of).alias("age_m"),
        (F.col("life_years") * 12.0).alias("life_m"))
    # all cohorts and both measures in one selection of medians
    cohorts = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in
                        (("keyword", F.col("keyword")), ("type", F.col("equip_type")), ("fleet", F.lit("all")))])
    measures = F.array(*[F.struct(F.lit(m).alias("m"), F.col(c).cast("double").alias("v")) for m, c in (("age", "age_m"), ("life", "life_m"))])
    long = rows.select(F.explode(measures).alias("x"), cohorts.alias("_cs")).where("x.v is not null") \
               .select("x.*", F.explode("_cs").alias("c")).select("c.*", "m", "v").where("key <> ''")
    found = materialize(exact_median(long, ["kind", "key", "m"], "v", "median", "n"))

    def cohort(kind, *key):
        r = found.where(F.col("kind") == kind).select(*[F.col("key").alias(k) for k in key], "m", "median", "n")
        pick = [F.max(F.when(F.col("m") == m, F.col("median"))).alias(f"median_{m}") for m in ("age", "life")]
        return r.groupBy(*key).agg(*pick, F.coalesce(F.max("n"), F.lit(0)).alias("n"))

    return cohort("keyword", "keyword"), cohort("type", "equip_type"), cohort("fleet")


def resolve_depreciation(assets: DataFrame, *, meta: DataFrame | None, purchase_by_id: DataFrame | None,
                         by_keyword: DataFrame | None, by_type: DataFrame | None, fleet: DataFrame | None,
                         overrides: DataFrame | None = None, params: Params = Params(),
                         price_col: str = "new_price") -> DataFrame:
    """Adds age_months, useful_life_months, book_value, basis, age_source,
    life_source, life_adj_months to one-row-per-asset ``assets`` (equip_id,
    keyword, equip_type, price)."""
    a = assets
    if meta is not None:
        a = a.join(meta.select("equip_id", F.col("purchase_date").alias("_m_date"),
                               F.col("depreciation_years").alias("_m_years"),
                               F.col("equip_type").alias("_m_type")), "equip_id", "left")
    else:
        a = a.withColumn("_m_date", F.lit(None).cast("date")).withColumn("_m_years", F.lit(None).cast("double")) \
             .withColumn("_m_type", F.lit(None).cast("string"))
    if purchase_by_id is not None:
        a = a.join(purchase_by_id.select("equip_id", F.col("year").alias("_p_year"),
                                         F.col("life_years").alias("_p_life")), "equip_id", "left")
    else:
        a = a.withColumn("_p_year", F.lit(None).cast("int")).withColumn("_p_life", F.lit(None).cast("double"))
    # cohort choice is by key presence; the median is tested afterwards
    etype = F.coalesce(F.when(F.col("equip_type") != "", F.col("equip_type")), F.col("_m_type"))
    a = a.withColumn("_etype", etype)
    if by_keyword is not None:
        kw = by_keyword.select(F.col("keyword").alias("_kw"), F.col("median_age").alias("_kw_age"),
                               F.col("median_life").alias("_kw_life"), F.lit(True).alias("_kw_hit"))
        a = a.join(kw, F.col("keyword") == F.col("_kw"), "left").drop("_kw")
    else:
        a = a.withColumn("_kw_hit", F.lit(None).cast("boolean")).withColumn("_kw_age", F.lit(None).cast("double")) \
             .withColumn("_kw_life", F.lit(None).cast("double"))
    if by_type is not None:
        ty = by_type.select(F.col("equip_type").alias("_ty"), F.col("median_age").alias("_ty_age"),
                            F.col("median_life").alias("_ty_life"), F.lit(True).alias("_ty_hit"))
        a = a.join(ty, F.col("_etype") == F.col("_ty"), "left").drop("_ty")
    else:
        a = a.withColumn("_ty_hit", F.lit(None).cast("boolean")).withColumn("_ty_age", F.lit(None).cast("double")) \
             .withColumn("_ty_life", F.lit(None).cast("double"))
    if fleet is not None:
        a = attach_one_row(a, fleet.select(F.col("median_age").alias("_fl_age"), F.col("median_life").alias("_fl_life")))
    else:
        a = a.withColumn("_fl_age", F.lit(None).cast("double")).withColumn("_fl_life", F.lit(None).cast("double"))

    kw_hit = F.coalesce(F.col("_kw_hit"), F.lit(False))
    ty_hit = F.coalesce(F.col("_ty_hit"), F.lit(False))
    coh_age = F.when(kw_hit, F.col("_kw_age")).when(ty_hit, F.col("_ty_age"))
    coh_life = F.when(kw_hit, F.col("_kw_life")).when(ty_hit, F.col("_ty_life"))

    age_d = age_months_from_date("_m_date", params.as_of).cast("double")
    age_y = age_months_from_year("_p_year", params.as_of).cast("double")
    age = F.coalesce(age_d, age_y, coh_age, F.col("_fl_age"))
    age_src = (F.when(age_d.isNotNull(), "summary_date").when(age_y.isNotNull(), "purchase_year")
               .when(coh_age.isNotNull(), "purchase_type_median")
               .when(F.col("_fl_age").isNotNull(), "purchase_fleet_median").otherwise("none"))
    p_life = F.when(F.col("_p_life") > 0, F.col("_p_life") * 12.0)
    m_life = F.when(F.col("_m_years") > 0, F.col("_m_years") * 12.0)
    default_life = F.lit(float(params.default_life_years) * 12.0)
    life = F.coalesce(p_life, m_life, coh_life, F.col("_fl_life"), default_life)
    life_src = (F.when(p_life.isNotNull(), "purchase_id").when(m_life.isNotNull(), "summary")
                .when(coh_life.isNotNull(), "purchase_type_median")
                .when(F.col("_fl_life").isNotNull(), "purchase_fleet_median").otherwise("default"))
    cost = F.coalesce(F.col(price_col).cast("double"), F.lit(0.0))
    a = a.withColumn("age_months", age).withColumn("useful_life_months", life) \
         .withColumn("age_source", age_src).withColumn("life_source", life_src)
    ok = F.col("age_months").isNotNull() & (F.col("useful_life_months") > 0) & (cost > 0)
    direct = F.col("age_source").isin("summary_date", "purchase_year") & \
        F.col("life_source").isin("purchase_id", "summary")
    a = a.withColumn("book_value", F.when(ok, book_value(cost, "age_months", "useful_life_months",
                                                         params.salvage_pct))) \
         .withColumn("basis", F.when(ok & direct, "Confirmed").when(ok, "Estimated").otherwise("—"))
    if overrides is not None:
        a = a.join(overrides.select("equip_id", F.col("extra_months").alias("_extra")), "equip_id", "left")
        extra = F.coalesce(F.col("_extra"), F.lit(0.0))
        ext = (extra > 0) & F.col("useful_life_months").isNotNull()
        new_life = F.col("useful_life_months") + extra
        new_bv = F.when(F.col("age_months").isNotNull() & (new_life > 0) & (cost > 0),
                        book_value(cost, "age_months", new_life, params.salvage_pct)).otherwise(F.col("book_value"))
        a = a.withColumn("book_value", F.when(ext, new_bv).otherwise(F.col("book_value"))) \
             .withColumn("basis", F.when(ext, "Manual").otherwise(F.col("basis"))) \
             .withColumn("life_source", F.when(ext, "manual_extension").otherwise(F.col("life_source"))) \
             .withColumn("useful_life_months", F.when(ext, new_life).otherwise(F.col("useful_life_months"))) \
             .withColumn("life_adj_months", extra).drop("_extra")
    else:
        a = a.withColumn("life_adj_months", F.lit(0.0))
    return a.drop(*[c for c in a.columns if c.startswith("_")])
