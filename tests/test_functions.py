"""Golden rows for the scalar expressions (cases derived from the contracts)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from upkeep import functions as U
from upkeep.functions.keywords import with_keyword, with_keyword_label


def one_col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_norm_equip_id(spark):
    assert one_col(spark, [" ab 1 ", None], U.norm_equip_id) == ["AB1", ""]


def test_building_normalise(spark):
    got = one_col(spark, ["Location: North Hall 153", "North Hall Room 12B", "12:30", "Total Orders 9",
                          "Live Stock Center"], U.normalize_building)
    assert got == ["North Hall", "North Hall", "", "", "Livestock Center"]


def test_building_abbrev(spark):
    got = one_col(spark, ["North Hall", "Maple", "Hall of the Arts", "R-2", "Hinckley"], U.abbreviate_building)
    assert got == ["NH", "MAP", "HA", "R2", "HIK"]


def test_money(spark):
    assert one_col(spark, ["$1,200.50", "Enter Data", "0", "-5"], U.parse_dollar_amount) == [1200.5, None, None, None]
    assert one_col(spark, ["-5", "", "x"], U.parse_dollar) == [-5.0, 0.0, 0.0]


def test_year(spark):
    assert one_col(spark, ["Aug 2019", "19", "2105", "1899"], U.parse_purchase_year) == [2019, None, None, None]


def test_extract_label(spark):
    got = one_col(spark, ["Equipment Id: 102395", "102395", "Location: A: B"], lambda c: U.extract_label(c, "id"))
    assert got[:2] == ["102395", "102395"]
    assert one_col(spark, ["Location: A: B"], lambda c: U.extract_label(c, "location")) == ["A: B"]


def test_repair_hours(spark):
    rows = [("found", ""), ("Found in closet", ""), (None, "item found"), (None, ""), ("1/2 hr", ""),
            ("1 5", ""), ("2.5 hours", ""), ("1,5", ""), ("3/0", ""), ("1 1/2", "")]
    df = spark.createDataFrame(rows, "d string, t string")
    got = [r[0] for r in df.select(U.parse_repair_hours("d", "t")).collect()]
    assert got == [0.5, 0.5, 0.5, 1.0, 0.5, 1.5, 2.5, 1.5, 1.0, 0.5]


def test_month_from_file_name(spark):
    got = one_col(spark, ["May Repair Report.csv", "June 2025 x.csv", "May_Report.csv"], U.month_from_file_name)
    assert got == ["2026-05", "2025-06", None]


def test_age_and_book_value(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 31),), (dt.date(2027, 1, 1),)], "d date")
    got = [r[0] for r in df.select(U.age_months_from_date("d", dt.date(2026, 2, 28))).collect()]
    assert got == [0, 0]
    y = spark.createDataFrame([(2020,)], "y int").select(U.age_months_from_year("y", dt.date(2026, 3, 15))).first()[0]
    assert y == 68
    bv = spark.createDataFrame([(0.0,), (48.0,), (200.0,)], "a double") \
              .select(U.book_value(F.lit(1000.0), "a", F.lit(96.0))).collect()
    assert [r[0] for r in bv] == [1000.0, 500.0, 50.0]


def test_status_rules(spark):
    df = spark.createDataFrame([(80.0,), (60.0,), (59.99,)], "c double")
    got = [r[0] for r in df.select(U.replace_status(F.lit(0.0), "c", F.lit(100.0))).collect()]
    assert got == ["Replace", "Monitor", "Good"]
    assert spark.range(1).select(U.replace_status(F.lit(1.0), F.lit(1.0), F.lit(0.0))).first()[0] == "Good"
    df = spark.createDataFrame([(100.0,), (80.0,), (79.0,), (None,)], "a double")
    got = [r[0] for r in df.select(U.life_status("a", F.lit(100.0))).collect()]
    assert got == ["Replace", "Monitor", "Good", None]
    r = spark.range(1).select(U.combine_status(F.lit("Good"), F.lit("Monitor")),
                              U.combine_status(F.lit(None).cast("string"), F.lit("Good"))).first()
    assert tuple(r) == ("Monitor", "Good")


def test_repair_count_bin(spark):
    got = one_col(spark, [0, 1, 2, 4, 5, 9], U.repair_count_bin, "int")
    assert got == ["1 repair", "1 repair", "2 repairs", "4 repairs", "5+ repairs", "5+ repairs"]


def test_keyword_key(spark):
    df = spark.createDataFrame([('ICE 18" scrubber',), ("Ladder 6 ft",), ("Step ladder",), ("Vacuum 12345",)], "n string")
    got = [r[0] for r in with_keyword(df, "n").select("keyword").collect()]
    assert got == ["scrubber|ice|18", "ladder|6ft", None, None]
    lab = [r[0] for r in with_keyword_label(with_keyword(df, "n")).select("label").collect()]
    assert lab[:2] == ['ICE 18" Scrubber', "6' Ladder"]


def test_regex_search_rejects_bad_pattern(spark):
    with pytest.raises(ValueError):
        U.regex_search("x", "(unclosed")


def test_optional_modes(spark):
    df = spark.createDataFrame([("1 1/2", ""), ("2 hrs", "")], "d string, t string")
    assert [r[0] for r in df.select(U.parse_repair_hours("d", "t", mixed_numbers=True)).collect()] == [1.5, 2.0]
    got = one_col(spark, ["May_Report.csv", "x_June_2027.csv"], lambda c: U.month_from_file_name(c, underscore_boundary=True))
    assert got == ["2026-05", "2027-06"]
