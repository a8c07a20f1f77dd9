"""Enriched repairs table: canonical repair rows + category + new price and its
source, the table every report reads.

Per-asset work (category, price cascade incl. the fuzzy catalog match) runs on
the distinct asset ids and is joined back to the repair rows once, so it
scales with the number of assets, not the number of repairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.operators.catalog_match import match_catalog
from upkeep.operators.category import resolve_category
from upkeep.operators.valuation import nearest_year_price, price_cascade
from upkeep.session import materialize


def catalog_prices_by_id(names: DataFrame, years: DataFrame, models: DataFrame, prices: DataFrame) -> DataFrame:
    """(equip_id, price): catalog model matched from the asset name, priced at
    its purchase year (nearest catalog year). ``names`` = (equip_id, equip_name),
    ``years`` = (equip_id, year)."""
    m = match_catalog(names, "equip_name", models)
    t = names.join(m, "equip_name").join(years, "equip_id").where(F.col("model").isNotNull()) \
             .select("equip_id", "model", F.col("year").alias("target_year"))
    return nearest_year_price(t, prices).select("equip_id", "price")


def enrich_repairs(rep: DataFrame, names: DataFrame, *, type_map: DataFrame | None, summary: DataFrame | None,
                   purchase: DataFrame | None, catalog: DataFrame | None, valuation: DataFrame | None,
                   service: DataFrame | None, keywords: DataFrame) -> DataFrame:
    """Adds category, new_price and price_source to repair rows.

    ``names`` = (equip_id, equip_name) per asset; ``keywords`` = (equip_id,
    keyword); price books are (equip_id | keyword, price)."""
    # written once: categories, keyword prices and the join back each start from the ids
    ids = materialize(rep.select("equip_id").distinct())
    a = ids.join(names, "equip_id", "left")
    a = resolve_category(a, "equip_name", type_map, summary)
    a = a.join(keywords, "equip_id", "left")
    a = price_cascade(a, purchase=purchase, catalog=catalog, valuation=valuation, service=service)
    return rep.join(a.select("equip_id", "category", "new_price", "price_source"), "equip_id", "left")
