"""Contract cases that the generated tables do not hold: marks and blanks of all
kinds, dates outside the holiday range, rows without ids, drifting CSV headers."""

import datetime as dt
import os
import tempfile
import unicodedata

import pytest
from pyspark.sql import functions as F

from upkeep.functions import norm_equip_id, strip_accents
from upkeep.functions.text import resolve_building_filter
from upkeep.operators.audit import validate_events
from upkeep.operators.calendar import business_calendar, with_business_days
from upkeep.operators.overrides import load_life_overrides, merge_overrides
from upkeep.operators.service_scope import effective_status_all
from upkeep.params import Params


def test_every_latin_letter_folds(spark):
    letters = [chr(n) for n in range(0xC0, 0x250)] + ["é", "ạ̈"]
    df = spark.createDataFrame([(x,) for x in letters], "s string")
    got = {r.s: r.t for r in df.select("s", strip_accents("s").alias("t")).collect()}
    for x in letters:
        bare = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
        assert got[x] == (bare if len(bare) == 1 else x), x


def test_ids_lose_no_break_spaces(spark):
    df = spark.createDataFrame([(" a 12　",), (" ",), (None,)], "s string")
    assert [r[0] for r in df.select(norm_equip_id("s")).collect()] == ["A12", "", ""]


def test_building_filter(spark):
    cases = {"Hinckley 153": "Hinckley", "clarke south stair": "Clarke", "hik": "Hinckley", "STC": "STC",
             "Location: Benson": "Benson", "xy": "xy", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.b for r in df.select("s", resolve_building_filter("s").alias("b")).collect()} == cases


def test_business_days_anywhere(spark):
    days = [dt.date(1850, 1, 5), dt.date(1970, 1, 1), dt.date(1999, 12, 30), dt.date(2000, 1, 1), dt.date(2021, 7, 3),
            dt.date(2035, 12, 25), dt.date(2036, 1, 2), dt.date(2150, 3, 7)]
    rows = [(a, a + dt.timedelta(days=k)) for a in days for k in (0, 1, 2, 9, 400)] + [(days[0], days[-1]), (days[1], None)]
    cal = business_calendar(spark, Params())
    off = {r.cal_date for r in cal.where("is_hol = 1").collect()}
    out = with_business_days(spark.createDataFrame(rows, "a date, b date"), "a", "b", "bd", cal).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.b is None:
            assert r.bd is None
            continue
        span = [r.a + dt.timedelta(days=i) for i in range((r.b - r.a).days + 1)]
        assert r.bd == (1 if r.a == r.b else sum(d.weekday() < 5 and d not in off for d in span)), (r.a, r.b)


def test_rows_without_id_share_nothing(spark):
    rows = [("", dt.date(2026, 4, 3), None, "Scheduled", "Fix", "2026-04"),
            (" ", dt.date(2026, 4, 4), dt.date(2026, 4, 9), "Completed", "Fix", "2026-04"),
            (None, dt.date(2026, 4, 5), None, "Scheduled", "Fix", "2026-04"),
            ("a 1", dt.date(2026, 4, 6), None, "Scheduled", "Fix", "2026-04"),
            ("A1", dt.date(2026, 4, 7), dt.date(2026, 4, 9), "Completed", "Fix", "2026-04")]
    s = spark.createDataFrame(rows, "equip_id string, sched_date date, completed_date date, status string, "
                                    "description string, month_key string")
    got = {r.sched_date.day: r.status for r in effective_status_all(s, s).collect()}
    assert got == {3: "Scheduled", 4: "Completed", 5: "Scheduled", 6: "Completed", 7: "Completed"}


def test_audit_rejects_unknown_events(spark):
    df = spark.createDataFrame([("export.pdf.orders", "ok"), ("export.pdf.overview", "fail")],
                               "event_type string, status string")
    assert validate_events(df).count() == 2
    for bad in (("export_pdf", "ok"), ("export.pdf.orders", "success"), ("export.pdf.orders", None)):
        with pytest.raises(Exception, match="unknown"):
            validate_events(spark.createDataFrame([bad], "event_type string, status string")).collect()


def test_override_details(spark):
    raw = spark.createDataFrame([("a 1", "junk", "2", "n", 1), ("B", " ", "2", " keep ", 2), ("C", "7.5", None, None, 3)],
                                "equipId string, extraMonths string, extraYears string, note string, row_ord int")
    base = load_life_overrides(raw)
    assert {r.equip_id: r.extra_months for r in base.collect()} == {"B": 24.0, "C": 7.5}
    ch = spark.createDataFrame([("C", 3.0, "first", 1), ("C", 6.0, "second", 2), ("D", 0.0, "", 3)],
                               "equip_id string, extra_months double, note string, row_ord int")
    got = {r.equip_id: tuple(r)[1:] for r in merge_overrides(base, ch, order_col="row_ord", updated_at="2026-05-01").collect()}
    assert got == {"B": (24.0, "keep", ""), "C": (6.0, "second", "2026-05-01")}


def test_settings_ranges_and_schema():
    from upkeep.sources.settings import merge_settings
    m = merge_settings({"baseAvailDays": 4000, "monthlyPartsBudget": "0", "annualPartsBudget": 12.9, "staffCount": "x",
                        "settingsSchemaVersion": 2, "staffCapacityByMonth": {" 2026-05 ": {"workDays": 99}, "x": 3}})
    assert (m["baseAvailDays"], m["monthlyPartsBudget"], m["annualPartsBudget"], m["staffCount"]) == (3660, 1, 12, 4)
    assert m["staffCapacityByMonth"] == {"2026-05": {"staffCount": 4, "hoursPerDay": 4, "workDays": 31}}
    old = merge_settings({"annualPartsBudget": 12})
    assert (old["annualPartsBudget"], old["monthlyPartsBudget"], old["settingsSchemaVersion"]) == (80000, 6667, 2)


def test_csv_files_unite_by_name(spark):
    from upkeep.sources.raw_grid import read_csv_grid
    from upkeep.sources.tables import read_csv_table
    d = tempfile.mkdtemp()
    wide = [f"h{i}" for i in range(70)]
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("Equipment Id,Cost\nA1,5\n\"B,\n2\",7\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("Cost,Vendor,Equipment Id\n9,Acme,C3\n")
    with open(os.path.join(d, "c.csv"), "w") as f:
        f.write(",".join(wide) + "\n" + ",".join(str(i) for i in range(70)) + "\n")
    t = read_csv_table(spark, d)
    assert t.columns == ["Equipment Id", "Cost", "Vendor", *wide, "source_file"]
    got = sorted((r["Equipment Id"], r["Cost"], r["Vendor"]) for r in t.where(F.col("h0").isNull()).collect())
    assert got == [("A1", "5", None), ("B,\n2", "7", None), ("C3", "9", "Acme")]
    assert t.where(F.col("h69") == "69").count() == 1
    assert read_csv_grid(spark, d).agg(F.max(F.size("cells"))).first()[0] == 70


def test_feed_keeps_late_rows_and_is_idempotent(spark):
    from upkeep.streaming.feeds import dedup_feed
    d = tempfile.mkdtemp()
    schema = "event_id long, ts timestamp, v string"
    run = os.path.basename(tempfile.mkdtemp())

    def add(name, rows):
        spark.createDataFrame([(i, dt.datetime(2026, 1, day), v) for i, day, v in rows], schema).coalesce(1) \
             .write.parquet(os.path.join(d, name))

    def feed():
        out = dedup_feed(spark, d + "/*", schema, "event_id", "ts", run_id=run)
        return sorted((r.event_id, r.v) for r in out.collect())

    add("one", [(1, 10, "a"), (1, 9, "b"), (2, 10, "c")])
    assert feed() == [(1, "b"), (2, "c")]
    add("two", [(1, 1, "late repeat"), (3, 1, "late new")])
    assert feed() == [(1, "b"), (2, "c"), (3, "late new")]
    assert feed() == [(1, "b"), (2, "c"), (3, "late new")]


def test_scored_sheet_prices(spark):
    from upkeep.operators.valuation import price_cascade, price_source_label
    assets = spark.createDataFrame([(1, "scrubber|ice|18"), (2, "scrubber|ice|30"), (3, "ladder|6ft"), (4, "buffer"), (5, None)],
                                   "equip_id long, keyword string")
    sheet = spark.createDataFrame([("scrubber|ice|20", 1.0, 1), ("scrubber|ice", 2.0, 2), ("scrubber|ice|18", 3.0, 3),
                                   ("ladder|6ft", 4.0, 4)], "keyword string, price double, sheet_ord int")
    service = spark.createDataFrame([(4, 9.0)], "equip_id long, price double")
    out = price_cascade(assets, valuation=sheet, service=service).withColumn("label", price_source_label())
    assert {r.equip_id: (r.new_price, r.label) for r in out.collect()} == {
        1: (3.0, "Valuation"), 2: (2.0, "Valuation"), 3: (4.0, "Valuation"), 4: (9.0, "Estimated"), 5: (0.0, "—")}
