"""The enriched repairs table reads its repair rows and price lists once each."""

import re

from pyspark.sql import functions as F

from upkeep.functions import parse_dollar_amount
from upkeep.operators.catalog_match import load_catalog, match_catalog
from upkeep.operators.stats import exact_median
from upkeep.operators.valuation import nearest_year_price
from upkeep.plans.enrich import enrich_repairs

CATALOG = [  # model, category, year, price, row_ord
    ("Tennant S20", "second", "2019", "$20", 2), (" Tennant S20 ", " first ", "2019", "$30", 1),
    ("Tennant S20", "later", "2019 ", "$40.5", 5), ("Tennant S20", "later", "2021", "enter data", 9),
    ("Tennant S20", "none", "2019", "-1", 0), ("Tennant S20", "none", "soon", "$7", 0),
    ("Tennant S20", "later", "2020", " $1,000 ", 6), ("  ", "blank", "2020", "$3", 0), (None, "null", "2020", "$3", 0),
    ("Windsor 15", None, "2018", "$9", 4), ("Windsor 15", "c", "2018", None, 3),
]


def written(df, tmp_path, name):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_catalog_rows_are_read_once(spark, tmp_path):
    raw, path = written(spark.createDataFrame(CATALOG, "model string, category string, year string, price string, row_ord int"), tmp_path, "raw")
    models, prices = load_catalog(raw)
    assert {(r.model, r.category, r.ord) for r in models.collect()} == {("Tennant S20", "first", 1), ("Windsor 15", None, 4)}
    assert sorted(tuple(r) for r in prices.collect()) == [("Tennant S20", 2019, 40.5), ("Tennant S20", 2020, 1000.0), ("Windsor 15", 2018, 9.0)]
    assert not [f for df in (models, prices) for f in df.inputFiles() if path in f]


def test_names_are_cleaned_once_each(spark, tmp_path):
    names, path = written(spark.createDataFrame([("tennant s20 unit",), ("tennant s20 unit",), ("",), (None,)], "equip_name string"), tmp_path, "names")
    models, _ = load_catalog(spark.createDataFrame(CATALOG, "model string, category string, year string, price string, row_ord int"))
    out = match_catalog(names, "equip_name", models)
    assert not [f for f in out.inputFiles() if path in f]
    assert {(r.equip_name, r.model) for r in out.collect()} == {("tennant s20 unit", "Tennant S20"), ("", None), (None, None)}


def test_nearest_year_is_sought_once_a_model_and_year(spark):
    targets = spark.createDataFrame([(1, "a", 2003), (2, "a", 2003), (2, "a", 2003), (3, "a", 1990), (4, "b", 2000), (5, None, 2000),
                                     (6, "a", None)], "equip_id int, model string, target_year int")
    prices = spark.createDataFrame([("a", 2002, 1.0), ("a", 2004, 2.0), ("c", 2000, 3.0)], "model string, year int, price double")
    out = nearest_year_price(targets, prices)
    assert out.columns == ["equip_id", "model", "target_year", "catalog_year", "price"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == [
        (1, "a", 2003, 2002, 1.0), (2, "a", 2003, 2002, 1.0), (3, "a", 1990, 2002, 1.0), (4, "b", 2000, None, None),
        (5, None, 2000, None, None), (6, "a", None, 2002, 1.0)]
    assert "min_by" in optimized(out) and not re.search(r"Aggregate \[equip_id[^\n]*min_by", optimized(out))


def test_histogram_of_a_median_is_made_once(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") * 1.5).alias("v"))
    out = exact_median(rows, ["k"], "v")
    assert out.count() == 7
    got = exact_median(rows, ["k"], "v")
    assert {r.k: r.median for r in got.collect()} == {r.k: r.m for r in rows.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_repair_rows_are_read_once(spark, tmp_path):
    rep, path = written(spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0), (None, 5.0)], "equip_id int, repair_parts double"), tmp_path, "rep")
    names = spark.createDataFrame([(1, "ladder 6 ft"), (2, "Tennant auto scrubber 20")], "equip_id int, equip_name string")
    out = enrich_repairs(
        rep, names, type_map=spark.createDataFrame([(1, "Steps")], "equip_id int, equip_type string"), summary=None,
        purchase=spark.createDataFrame([(1, 70.0)], "equip_id int, price double"), catalog=None,
        valuation=spark.createDataFrame([("scrubber|tennant|20", 900.0)], "keyword string, price double"),
        service=None, keywords=spark.createDataFrame([(2, "scrubber|tennant|20")], "equip_id int, keyword string"))
    assert {(r.equip_id, r.repair_parts, r.category, r.new_price, r.price_source) for r in out.collect()} == {
        (1, 2.0, "Steps", 70.0, "purchase"), (1, 3.0, "Steps", 70.0, "purchase"), (2, 4.0, "Scrubber", 900.0, "valuation"),
        (None, 5.0, None, None, None)}
    assert len(re.findall(r"Relation \[[^\]]*repair_parts", optimized(out))) == 1


def test_dollar_cells(spark):
    cells = ["  $1,200.50 ", " $5 ", "", " ", None, "Enter Data", " ENTER DATA ", "$enter data", "1e3", "-5", "0", "$", ",", "Infinity", "7 8"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    assert [r.v for r in df.select("i", parse_dollar_amount("c").alias("v")).orderBy("i").collect()] == [
        1200.5, 5.0, None, None, None, None, None, None, 1000.0, None, None, None, None, float("inf"), None]
