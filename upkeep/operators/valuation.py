"""Keyword price books: medians per keyword, the valuation sheet and the
nearest-year catalog lookup. Medians use the histogram method
(``upkeep.operators.stats``), so a hot keyword is reduced map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.functions.keywords import with_keyword_label
from upkeep.operators.stats import exact_median


def keyword_medians(records: DataFrame, value_col: str, recent_years: int = 0,
                    reference_year: int | None = None, out: str = "median_price") -> DataFrame:
    """Median of positive ``value_col`` per keyword; with ``recent_years`` > 0 a
    keyword that has records within that many years of ``reference_year`` uses
    only those."""
    r = records.where(F.col("keyword").isNotNull() & (F.col(value_col) > 0))
    if recent_years > 0:
        recent = F.col("year").isNotNull() & ((F.lit(reference_year) - F.col("year")) <= recent_years)
        r = r.withColumn("_recent", recent)
        has = r.groupBy("keyword").agg(F.max(F.col("_recent").cast("int")).alias("_has"))
        r = r.join(has, "keyword").where((F.col("_has") == 0) | F.col("_recent"))
    return exact_median(r, ["keyword"], value_col, out, "n_records")


def valuation_sheet(purchase: DataFrame, service: DataFrame, recent_years: int = 0,
                    reference_year: int | None = None) -> DataFrame:
    """One row per keyword: purchase median, else service median; label; source."""
    pm = keyword_medians(purchase, "cost", recent_years, reference_year, "purchase_price") \
        .select("keyword", "purchase_price")
    sm = keyword_medians(service, "price", 0, None, "service_price").select("keyword", "service_price")
    j = pm.join(sm, "keyword", "full_outer")
    j = j.withColumn("price", F.coalesce("purchase_price", "service_price")) \
         .withColumn("price_source", F.when(F.col("purchase_price").isNotNull(), "purchase").otherwise("service"))
    return with_keyword_label(j.select("keyword", "price", "price_source"), "keyword", "label") \
        .orderBy(F.lower("label"), "keyword")


def nearest_year_price(targets: DataFrame, catalog: DataFrame, model_col: str = "model") -> DataFrame:
    """Price for each target (model, target_year): the exact catalog year, else
    the nearest year (earlier year on ties); clamping to the first/last year is
    the nearest rule at the ends. Equi join on the model: candidates are that
    model's catalog years only, and each (model, target_year) asks once however
    many targets share it."""
    asked = [model_col, "target_year"]
    j = targets.select(*asked).distinct().join(catalog, model_col, "left")
    dist = F.abs(F.col("year") - F.col("target_year"))
    best = F.min_by(F.struct(F.col("year").alias("catalog_year"), F.col("price").alias("price")),
                    F.struct(dist.alias("d"), F.col("year").alias("y")))
    keys = [c for c in targets.columns]
    found = j.groupBy(*asked).agg(best.alias("_b")).select(*[F.col(c).alias(f"_a{i}") for i, c in enumerate(asked)], "_b")
    same = F.lit(True)
    for i, c in enumerate(asked):  # targets without a model or year stay, as any other
        same = same & F.col(c).eqNullSafe(F.col(f"_a{i}"))
    return targets.distinct().join(found, same, "left").select(*keys, "_b.catalog_year", "_b.price")


def first_valid_price(rows: DataFrame, id_col: str, price_col: str, order_col: str = "row_ord") -> DataFrame:
    """Per id, the first row (file order) with a positive price."""
    return rows.where(F.col(price_col) > 0).groupBy(id_col) \
               .agg(F.min_by(F.col(price_col), F.col(order_col)).alias(price_col))


def price_cascade(assets: DataFrame, *, purchase: DataFrame | None = None, catalog: DataFrame | None = None,
                  valuation: DataFrame | None = None, service: DataFrame | None = None,
                  id_col: str = "equip_id") -> DataFrame:
    """New price and its source per asset: purchase book by id -> catalog by
    model and purchase year -> valuation sheet by keyword -> service estimate by
    id -> 0 with a blank source. The sheet (keyword, price, optional sheet_ord) is
    looked up with ``scored_keyword_price``: exact keyword, else the best row of the
    brand, else the unbranded category; without ``sheet_ord`` its rows rank by
    keyword. All lookups are one-row-per-key equi joins."""
    a = assets
    tiers = []
    if purchase is not None:
        a = a.join(purchase.select(id_col, F.col("price").alias("_p1")), id_col, "left"); tiers.append(("_p1", "purchase"))
    if catalog is not None:
        a = a.join(catalog.select(id_col, F.col("price").alias("_p2")), id_col, "left"); tiers.append(("_p2", "custodial"))
    if valuation is not None:
        sheet = valuation.where(F.col("price") > 0)
        order = "sheet_ord" if "sheet_ord" in sheet.columns else "keyword"
        sheet = sheet.select("keyword", "price", F.col(order).alias("sheet_ord"))
        found = scored_keyword_price(a.select("keyword"), sheet)
        a = a.join(found.select("keyword", F.col("price").alias("_p3")), "keyword", "left"); tiers.append(("_p3", "valuation"))
    if service is not None:
        a = a.join(service.select(id_col, F.col("price").alias("_p4")), id_col, "left"); tiers.append(("_p4", "service"))
    valid = [F.when(F.col(c) > 0, F.col(c)) for c, _ in tiers]
    price = F.coalesce(*valid, F.lit(0.0))
    src = None
    for (c, label), v in zip(tiers, valid):
        src = F.when(v.isNotNull(), F.lit(label)) if src is None else src.when(v.isNotNull(), F.lit(label))
    src = src.otherwise(F.lit("")) if src is not None else F.lit("")
    return a.withColumn("new_price", price).withColumn("price_source", src).drop(*[c for c, _ in tiers])


# ---- fixed values: display labels of price sources ----------------------------
PRICE_SOURCE_LABEL = {"purchase": "Accurate", "custodial": "Catalog", "valuation": "Valuation",
                      "service": "Estimated", "": "—"}
# -------------------------------------------------------------------------------


def price_source_label(c="price_source"):
    """Display label of a price source; an unknown source reads as none."""
    known = F.create_map(*[F.lit(x) for kv in PRICE_SOURCE_LABEL.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.coalesce(F.col(c), F.lit(""))), F.lit(PRICE_SOURCE_LABEL[""]))


def scored_keyword_price(keys: DataFrame, sheet: DataFrame, key_col: str = "keyword",
                         order_col: str = "sheet_ord") -> DataFrame:
    """Sheet price for each keyword: exact key; else, for a branded key, the
    same-brand sheet row scoring +4 for the same category and +2 for the same
    size (a different size excludes the row; earlier sheet row on ties); else,
    for an unbranded key, the first unbranded row of the same category whose
    size agrees when the key has one. Candidate rows come from equi joins on
    the brand or the category."""
    from upkeep.functions.keywords import keyword_parts
    k = keys.select(key_col).where(F.col(key_col).isNotNull()).distinct() \
            .withColumn("_p", keyword_parts(key_col)) \
            .select(key_col, F.col("_p.category").alias("k_cat"), F.col("_p.brand").alias("k_brand"),
                    F.col("_p.size").alias("k_size"))
    s = sheet.withColumn("_p", keyword_parts("keyword")) \
             .select(F.col("keyword").alias("s_key"), "price", F.col(order_col).alias("s_ord"),
                     F.col("_p.category").alias("s_cat"), F.col("_p.brand").alias("s_brand"),
                     F.col("_p.size").alias("s_size"))
    from upkeep.session import materialize
    # both sides hold one row per keyword (vocabulary-sized); computed once, read by three branches
    k, s = materialize(k), materialize(s)
    exact = k.join(s, k[key_col] == s.s_key).select(key_col, F.col("price").alias("_exact"))
    br = k.where(F.col("k_brand").isNotNull()).join(s, F.col("k_brand") == F.col("s_brand")) \
          .where(~(F.col("k_size").isNotNull() & F.col("s_size").isNotNull() & (F.col("k_size") != F.col("s_size"))))
    score = F.when(F.col("s_cat") == F.col("k_cat"), 4).otherwise(0) + \
        F.when(F.col("k_size").isNotNull() & (F.col("s_size") == F.col("k_size")), 2).otherwise(0)
    branded = br.groupBy(key_col).agg(F.min_by("price", F.struct((-score).alias("a"), F.col("s_ord").alias("b")))
                                      .alias("_branded"))
    ub = k.where(F.col("k_brand").isNull()).join(s.where(F.col("s_brand").isNull()),
                                                 F.col("k_cat") == F.col("s_cat")) \
          .where(F.col("k_size").isNull() | (F.col("s_size") == F.col("k_size")))
    unbranded = ub.groupBy(key_col).agg(F.min_by("price", "s_ord").alias("_unbranded"))
    out = k.join(exact, key_col, "left").join(branded, key_col, "left").join(unbranded, key_col, "left")
    price = F.when(F.col("_exact").isNotNull(), F.col("_exact")) \
             .when(F.col("k_brand").isNotNull(), F.col("_branded")).otherwise(F.col("_unbranded"))
    src = F.when(F.col("_exact").isNotNull(), "exact").when(price.isNotNull(),
                                                            F.when(F.col("k_brand").isNotNull(), "brand")
                                                            .otherwise("category"))
    return out.select(key_col, price.alias("price"), src.alias("match"))


# ---- price-book loaders (first valid row per key wins) -------------------------------
def purchase_price_map(rows: DataFrame, id_col: str = "equip_id", cost_col: str = "cost",
                       order_col: str = "row_ord") -> DataFrame:
    """id -> cost from the first row with a valid positive cost (invalid rows are
    skipped before 'first wins')."""
    from upkeep.functions import norm_equip_id, parse_dollar_amount
    r = rows.select(norm_equip_id(id_col).alias("equip_id"), parse_dollar_amount(cost_col).alias("price"), order_col)
    return r.where((F.col("equip_id") != "") & F.col("price").isNotNull()).groupBy("equip_id") \
            .agg(F.min_by("price", order_col).alias("price"))


def purchase_year_map(rows: DataFrame, id_col: str = "equip_id", year_col: str = "year",
                      order_col: str = "row_ord") -> DataFrame:
    """id -> purchase year from the first row with a valid year."""
    from upkeep.functions import norm_equip_id, parse_purchase_year
    r = rows.select(norm_equip_id(id_col).alias("equip_id"), parse_purchase_year(year_col).alias("year"), order_col)
    return r.where((F.col("equip_id") != "") & F.col("year").isNotNull()).groupBy("equip_id") \
            .agg(F.min_by("year", order_col).alias("year"))


def load_valuation_sheet(rows: DataFrame, label_col: str = "Equipment", price_col: str = "price",
                         order_col: str = "row_ord") -> DataFrame:
    """Sheet rows -> (keyword, price, sheet_ord): key = keyword of the label, else
    the normalised label; first row with a valid positive price per key wins."""
    from upkeep.functions import norm_equipment_name, parse_dollar_amount
    from upkeep.functions.keywords import with_keyword
    r = rows.select(F.col(label_col).alias("_label"), parse_dollar_amount(price_col).alias("price"), order_col)
    r = with_keyword(r, "_label", "_kw").withColumn("keyword", F.coalesce("_kw", norm_equipment_name("_label")))
    r = r.where((F.col("keyword") != "") & F.col("price").isNotNull())
    return r.groupBy("keyword").agg(F.min_by("price", order_col).alias("price"), F.min(order_col).alias("sheet_ord"))


def merge_price_sheets(base: DataFrame, extra: DataFrame, overwrite: bool = False) -> DataFrame:
    """Union of two keyword price books: base wins unless ``overwrite``."""
    b = base.select("keyword", F.col("price").alias("_b"))
    e = extra.select("keyword", F.col("price").alias("_e"))
    j = b.join(e, "keyword", "full_outer")
    price = F.coalesce("_e", "_b") if overwrite else F.coalesce("_b", "_e")
    return j.select("keyword", price.alias("price"))
