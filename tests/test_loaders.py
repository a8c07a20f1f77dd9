"""Loaders and small helpers: first/last-row rules and golden rows from FIXTURES."""

import os
import tempfile

from pyspark.sql import functions as F

from upkeep.operators.overrides import load_life_overrides
from upkeep.operators.rollup import asset_snapshot, calendar_year
from upkeep.operators.valuation import (load_valuation_sheet, merge_price_sheets, purchase_price_map,
                                        purchase_year_map)
from upkeep.sinks import export_report, output_name


def test_life_overrides_golden(spark):
    rows = [("A", "12", None, 1), ("B", "300", None, 2), ("C", "-1", None, 3), ("D", "", "2", 4),
            ("A", "6", None, 5)]
    df = spark.createDataFrame(rows, "equip_id string, extra_months string, extra_years string, row_ord int")
    got = {r.equip_id: r.extra_months for r in load_life_overrides(df).collect()}
    assert got == {"A": 6.0, "B": 240.0, "D": 24.0}  # last row wins for A; C dropped


def test_purchase_maps_first_valid_row(spark):
    rows = [(" a 1", "Enter Data", "n/a", 1), ("A1", "$1,200", "Aug 2019", 2), ("A1", "$900", "2015", 3)]
    df = spark.createDataFrame(rows, "equip_id string, cost string, year string, row_ord int")
    assert purchase_price_map(df).first().price == 1200.0
    assert purchase_year_map(df).first().year == 2019


def test_valuation_sheet_load_and_merge(spark):
    rows = [('ICE 18" Scrubber', "Enter Data", 1), ('ICE 18" Scrubber', "$4,000", 2), ("Step stool", "$40", 3),
            ('ICE 18" scrubber', "$5,000", 4)]
    sheet = load_valuation_sheet(spark.createDataFrame(rows, "Equipment string, price string, row_ord int"))
    got = {r.keyword: r.price for r in sheet.collect()}
    assert got == {"scrubber|ice|18": 4000.0, "step stool": 40.0}
    extra = spark.createDataFrame([("scrubber|ice|18", 1.0), ("ladder|6ft", 2.0)], "keyword string, price double")
    keep = {r.keyword: r.price for r in merge_price_sheets(sheet, extra).collect()}
    over = {r.keyword: r.price for r in merge_price_sheets(sheet, extra, overwrite=True).collect()}
    assert keep["scrubber|ice|18"] == 4000.0 and over["scrubber|ice|18"] == 1.0 and keep["ladder|6ft"] == 2.0


def test_snapshot_year_and_names(spark):
    rows = [(1, "Vac", "Hall", 2.0, 1.0, 1, "2026-01"), (1, None, "Annex", 3.0, 2.0, 2, "2025-12"),
            (2, "Fan", "Hall", 9.0, 9.0, 3, "2026-02")]
    df = spark.createDataFrame(rows, "equip_id int, equipment string, location string, parts double, "
                                     "labor double, row_ord int, month_key string")
    s = asset_snapshot(df, 1).first()
    assert (s.equipment, s.location, s.parts, s.labor, s.n_rows) == ("Vac", "Hall", 5.0, 3.0, 2)
    assert calendar_year(df, 2026).count() == 2
    files = spark.createDataFrame([("raw.csv", "2026-05"), ("May Report (v2).csv", None)], "f string, m string")
    assert [r[0] for r in files.select(output_name("f", "m")).collect()] == [
        "May_Repair_List_All_Work_Orders.csv", "May_Report_v2_cleaned.csv"]


def test_export_report_writes_rows_and_audit(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([("<b>Vac</b>", 1.0), ("Fan", 2.0)], "equipment string, cost double")
    n = export_report(df, os.path.join(d, "out"), event_type="export.pdf.replacement", username="u", user_id=1, role="admin",
                      month_key="ALL", filters={"status": "Replace"}, building_scope=[],
                      audit_path=os.path.join(d, "audit"))
    assert n == 2
    assert {r.equipment for r in spark.read.parquet(os.path.join(d, "out")).collect()} == {"Vac", "Fan"}
    a = spark.read.parquet(os.path.join(d, "audit")).first()
    assert a.row_count == 2 and a.event_type == "export.pdf.replacement" and a.status == "ok"


def test_csv_report_roundtrip_and_type_lookups(spark):
    from upkeep.functions import text_or_empty
    from upkeep.operators.category import merge_type_lookups, type_map
    from upkeep.sinks import write_csv_report
    from upkeep.sources.tables import reread_cleaned
    d = tempfile.mkdtemp()
    out = os.path.join(d, "cleaned")
    write_csv_report(spark.createDataFrame([("A", "Vac")], "EquipmentId string, Name string"), out)
    back = reread_cleaned(spark, out, "all_equipment_summary.csv")
    assert [(r.EquipmentId, r.Name) for r in back.collect()] == [("A", "Vac")]
    assert spark.createDataFrame([(" x ",), (None,)], "v string").select(text_or_empty("v")).collect() == \
        [("x",), ("",)]
    rows = spark.createDataFrame([(1, "Vac", 1), (1, " ", 2), (1, "Fan", 3), (2, "Mop", 4)],
                                 "equip_id int, equip_type string, row_ord int")
    assert {r.equip_id: r.equip_type for r in type_map(rows, last=True).collect()} == {1: "Fan", 2: "Mop"}
    assert {r.equip_id: r.equip_type for r in type_map(rows).collect()} == {1: "Vac", 2: "Mop"}
    other = spark.createDataFrame([(2, "Cart"), (3, "Lift")], "equip_id int, equip_type string")
    merged = {r.equip_id: r.equip_type for r in merge_type_lookups(type_map(rows), other).collect()}
    assert merged == {1: "Vac", 2: "Mop", 3: "Lift"}
