import json
import os
import tempfile

from pyspark.sql import functions as F

from upkeep.operators.options import page_size
from upkeep.params import Params
from upkeep.sources.settings import (decode_token, decode_token_col, encode_token, params_from_settings,
                                     read_settings)


def test_page_size():
    assert [page_size(v) for v in (None, "all", "ALL", 0, 50, 10 ** 9, "x")] == [20, None, None, 1, 50, 10 ** 9, 20]


def test_settings_clamp_and_defaults(spark):
    d = tempfile.mkdtemp()
    path = os.path.join(d, "s.json")
    with open(path, "w") as f:
        json.dump({"staffCount": 900, "hoursPerDay": "x", "workDays": 10, "weekStartsOn": "Monday"}, f)
    p = params_from_settings(read_settings(spark, path))
    assert (p.staff_count, p.hours_per_day, p.work_days, p.week_starts_on) == (500, Params().hours_per_day, 10, "monday")


def test_token_codec(spark):
    t = encode_token({"month": "2026-05", "b": "1"})
    assert decode_token(t) == {"month": "2026-05", "b": "1"}
    assert decode_token("%%%") is None
    df = spark.createDataFrame([(t,), ("@@",)], "t string")
    got = [r[0] for r in df.select(decode_token_col("t")).collect()]
    assert got[0] == {"b": "1", "month": "2026-05"} and got[1] is None


def test_write_canonical_partitions(spark):
    from upkeep.sinks import write_canonical
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([("2026-05", 1.0), ("2026-06", 2.0)], "month_key string, hours double")
    write_canonical(df, d)
    back = spark.read.parquet(d)
    assert back.where(F.col("month_key") == "2026-06").count() == 1
    assert sorted(os.listdir(d))[0].startswith("_") or "month_key=2026-05" in os.listdir(d)


def test_overview_all_scope(spark):
    from upkeep.plans.overview import drill_down, overview
    from upkeep.sources import bench
    sf = "/root/testdata/sf0.001"
    cat = bench.assets(spark, sf).select("equip_id", "category")
    out = overview(spark, "ALL", bench.requests(spark, sf), bench.service(spark, sf).join(cat, "equip_id", "left"),
                   bench.repairs_rows(spark, sf).join(cat, "equip_id", "left"), cat)
    assert out["kpis"].count() == 1 and out["parts_budget"].count() == 1
    assert drill_down("repair_count_mix", "2 repairs") == {"report": "replacement", "repair_count_bin": "2 repairs"}


def test_excel_source_reports_unavailable(spark):
    from upkeep.sources import excel
    if any(excel.available().values()):
        return
    import pytest
    with pytest.raises(RuntimeError):
        excel.read_excel_grid(spark, tempfile.mkdtemp())


def test_csv_grid_and_incremental_ingest(spark):
    """CSV exports with preamble rows, a multi-line header cell, a quoted comma and
    a short row; a second file arriving later is picked up by the next run."""
    from upkeep.plans.jobs import load_repairs_grid
    from upkeep.sources.raw_grid import read_csv_grid
    from upkeep.streaming.feeds import export_ingest
    src = tempfile.mkdtemp()
    with open(os.path.join(src, "May 2026 Repairs.csv"), "w") as f:
        f.write('Title,,\nGenerated,,\n#,Completed Date,"Equipment\nName",Parts Cost $\n'
                '1,5/2/2026,"Vac, red",3.5\n2,5/3/2026,Ladder\nTotal,,,\n')
    g = read_csv_grid(spark, src)
    rows = load_repairs_grid(g).orderBy("row_no").collect()
    assert [(r.equipment, r.parts, r.month_key) for r in rows] == [("Vac, red", 3.5, "2026-05"), ("Ladder", 0.0, "2026-05")]
    target = os.path.join(tempfile.mkdtemp(), "repairs")
    run = "t1"
    out = export_ingest(spark, src, load_repairs_grid, target, run_id=run)
    assert out.count() == 2
    with open(os.path.join(src, "June 2026 Repairs.csv"), "w") as f:
        f.write('#,Completed Date,Equipment Name\n1,6/1/2026,Fan\n')
    out = export_ingest(spark, src, load_repairs_grid, target, run_id=run)
    assert out.count() == 3


def test_csv_table_sql_and_display(spark):
    from upkeep.functions.display import money, months, months_adjustment
    from upkeep.sources.tables import csv_sql, first_present, read_csv_table
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("Equipment Id,Cost\nA1,5\nB2,7\n")
    t = read_csv_table(spark, d)
    assert first_present(t, ("Equipment ID", "Equipment Id")) == "Equipment Id"
    r = csv_sql(spark, "SELECT count(*) AS n FROM csv_input WHERE `Equipment Id` = :eid", d, eid="B2").first()
    assert r.n == 1
    row = spark.createDataFrame([(1234.5, 12.4, 6.0)], "m double, a double, x double") \
               .select(money("m"), money("m", True), months("a"), months_adjustment("x")).first()
    assert tuple(row) == ("$1,234.50", "$1,234", "12 mo", "+6 mo")  # half to even, like Python format


def test_row_numbers_dense_across_splits(spark):
    from upkeep.sources.raw_grid import read_csv_grid
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "big.csv"), "w") as f:
        for i in range(2000):
            f.write(f"{i},x{i}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        g = read_csv_grid(spark, d)
        assert g.rdd.getNumPartitions() > 1
        rows = g.select("row_no", F.col("cells")[0].alias("c")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.row_no, int(r.c)) for r in rows) == [(i, i) for i in range(2000)]


def test_overview_month_scope(spark):
    from upkeep.operators import metrics as M
    from upkeep.plans.overview import overview
    from upkeep.sources import bench
    sf = "/root/testdata/sf0.001"
    cat = bench.assets(spark, sf).select("equip_id", "category")
    rep = bench.repairs_rows(spark, sf).join(cat, "equip_id", "left")
    ov = M.capacity_table(spark, {"1998-06": {"staffCount": 2, "hoursPerDay": 5, "workDays": 10}})
    out = overview(spark, "1998-06", bench.requests(spark, sf), bench.service(spark, sf).join(cat, "equip_id", "left"),
                   rep, cat, capacity_overrides=ov)
    cap = out["staff_capacity"].collect()
    assert len(cap) == 1 and cap[0].capacity_hours == 100.0
    assert out["parts_budget"].first().budget == 6667.0
    assert out["request_calendar"].count() == 30
    hours = rep.where("month_key = '1998-06'").agg(F.sum("hours")).first()[0]
    assert abs(cap[0].used_hours - hours) < 1e-9
