"""Operator contracts on small fixtures, checked against brute force."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from upkeep.operators.calendar import business_calendar, with_business_days
from upkeep.operators.overrides import merge_overrides
from upkeep.operators.service_scope import collapse_stale_duplicates, prepare_service_for_display
from upkeep.operators.stats import exact_median
from upkeep.operators.windows import forward_fill, latest_per_key
from upkeep.params import Params
from upkeep.sources.exports import union_by_name


def test_business_days_golden(spark):
    cal = business_calendar(spark, Params())
    rows = [(dt.date(2026, 5, 2), dt.date(2026, 5, 2)), (dt.date(2026, 5, 2), dt.date(2026, 5, 3)),
            (dt.date(2026, 7, 2), dt.date(2026, 7, 6)), (dt.date(2026, 12, 24), dt.date(2026, 12, 28)),
            (dt.date(2026, 6, 18), dt.date(2026, 6, 22)), (dt.date(2026, 6, 22), dt.date(2026, 6, 18))]
    df = spark.createDataFrame(rows, "a date, b date").withColumn("i", F.monotonically_increasing_id())
    got = [r.bd for r in with_business_days(df, "a", "b", "bd", cal).orderBy("i").collect()]
    assert got == [1.0, 0.0, 2.0, 2.0, 2.0, None]


def test_holidays_match_public_calendar(spark):
    from pandas.tseries.holiday import USFederalHolidayCalendar
    expected = {d.date() for d in USFederalHolidayCalendar().holidays(start="2000-01-01", end="2035-12-31")}
    cal = business_calendar(spark, Params()).toPandas()
    cal["wd"] = pd.to_datetime(cal.cal_date).dt.weekday
    got = {d for d, bd, wd in zip(cal.cal_date, cal.is_bd, cal.wd) if bd == 0 and wd < 5}
    assert got == expected


def test_business_days_monotone(spark):
    cal = business_calendar(spark, Params())
    rows = [(dt.date(2024, 1, 1), dt.date(2024, 1, 1) + dt.timedelta(days=k)) for k in range(60)]
    df = spark.createDataFrame(rows, "a date, b date")
    vals = [r.bd for r in with_business_days(df, "a", "b", "bd", cal).orderBy("b").collect()]
    assert all(x <= y for x, y in zip(vals[1:], vals[2:]))


def test_exact_median_matches_pandas(spark):
    data = [("a", float(v)) for v in [1, 2, 2, 9]] + [("b", float(v)) for v in [5, 1, 3]] + [("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r.m for r in exact_median(df, ["k"], "v", "m").collect()}
    assert got == {"a": 2.0, "b": 3.0}


def test_latest_per_key(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1), ("A", dt.date(2024, 1, 1), 2), ("A", None, 3)],
                               "k string, d date, row_ord int")
    r = latest_per_key(df, "k", "d").collect()
    assert len(r) == 1 and r[0].d == dt.date(2024, 1, 1)


def test_forward_fill_resets_together(spark):
    rows = [("f", 0, "A", "n1"), ("f", 1, None, None), ("f", 2, "B", None), ("f", 3, None, None)]
    df = spark.createDataFrame(rows, "file string, row_no int, id string, name string")
    out = forward_fill(df, ["file"], "row_no", F.col("id").isNotNull(), ["id", "name"], bucket_rows=2)
    got = [(r.ctx_id, r.ctx_name) for r in out.orderBy("row_no").collect()]
    assert got == [("A", "n1"), ("A", "n1"), ("B", None), ("B", None)]


def _svc(spark, rows):
    return spark.createDataFrame(rows, "equip_id long, sched_date date, completed_date date, status string, "
                                       "description string, month_key string, row_ord int")


def test_stale_pair_keeps_completed(spark):
    s = _svc(spark, [(1, dt.date(2026, 4, 3), None, "Scheduled", "Fix", "2026-04", 1),
                     (1, dt.date(2026, 4, 3), dt.date(2026, 4, 9), "Completed", "Fix", "2026-04", 2),
                     (2, dt.date(2026, 4, 3), None, "Scheduled", "Fix", "2026-04", 3),
                     (2, dt.date(2026, 4, 3), None, "Scheduled", "Fix", "2026-04", 4)])
    out = collapse_stale_duplicates(s).orderBy("row_ord").collect()
    assert [r.row_ord for r in out] == [2, 3, 4]


def test_month_scope_late_completion_is_scheduled(spark):
    s = _svc(spark, [(1, dt.date(2026, 4, 3), dt.date(2026, 5, 2), "Completed", "Fix", "2026-04", 1)])
    assert prepare_service_for_display(s, "2026-04").first().status == "Scheduled"


def test_all_scope_completed_elsewhere(spark):
    s = _svc(spark, [(1, dt.date(2026, 4, 3), None, "Scheduled", "Fix", "2026-05", 1),
                     (1, dt.date(2026, 5, 3), dt.date(2026, 5, 9), "Completed", "Fix", "2026-05", 2)])
    out = prepare_service_for_display(s, "ALL").collect()
    assert {r.status for r in out} == {"Completed"}


def test_override_merge(spark):
    base = spark.createDataFrame([(1, 12.0), (2, 24.0)], "equip_id long, extra_months double")
    ch = spark.createDataFrame([(2, -1.0), (3, 300.0)], "equip_id long, extra_months double")
    got = {r.equip_id: r.extra_months for r in merge_overrides(base, ch).collect()}
    assert got == {1: 12.0, 3: 240.0}


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    b = spark.createDataFrame([(3, 4)], "b int, c int")
    rows = sorted(union_by_name([a, b]).collect(), key=lambda r: r.b)
    assert [tuple(r) for r in rows] == [(1, 2, None), (None, 3, 4)]


@pytest.fixture
def many_ranges(spark):
    """Small ranges are not put together, as large ones would not be."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_dense_number_after_shuffle(spark, many_ranges):
    """1..n per group after a filter and a shuffle, with a group that spreads over many files."""
    from upkeep.operators.windows import dense_number
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 != 1, F.concat(F.lit("f"), F.col("id") % 7)).alias("file"),
                                  ((F.col("id") * 7919) % 3001).alias("row_no"))
    kept = df.where(F.col("row_no") % 2 == 1).repartition(5)
    out = dense_number(kept, "file", "row_no", "n", "all").collect()
    want, seen = {}, {}
    for r in sorted(kept.collect(), key=lambda r: r.row_no):
        seen[r.file] = seen.get(r.file, 0) + 1
        want[r.file, r.row_no] = seen[r.file]
    assert {(r.file, r.row_no): r.n for r in out} == want and len(out) == len(want)
    assert all(r["all"] == seen[r.file] for r in out) and None in seen and seen["hot"] > 400


def test_dense_number_whole_table_and_empty(spark):
    from upkeep.operators.windows import dense_number
    df = spark.createDataFrame([(5,), (None,), (3,)], "v int")
    assert [(r.v, r.n) for r in dense_number(df, [], "v", "n", start=0).orderBy("n").collect()] == [(None, 0), (3, 1), (5, 2)]
    assert dense_number(df.where("v > 9"), "v", "v", "n").columns == ["v", "n"] and dense_number(df.where("v > 9"), "v", "v", "n").count() == 0


def test_ranged_report_pages(spark, many_ranges):
    """Pages of any depth equal a full sort, and read only the files they lie in."""
    from upkeep.operators.windows import RangedReport
    df = spark.range(2000).select(F.when(F.col("id") % 11 != 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("status"), ((F.col("id") * 7919) % 2003).alias("v"))
    report = RangedReport(df, [F.col("status").desc_nulls_last(), F.col("v").asc()])
    rows = sorted(((r.status, r.v) for r in df.collect()), key=lambda x: (x[0] is None, [-ord(c) for c in x[0] or ""], x[1]))
    for page_no, size in ((0, 7), (3, 500), (66, 30), (199, 10), (0, 5000), (40, 50)):
        got = sorted((r.place, r.status, r.v) for r in report.page(page_no, size).collect())
        assert got == [(k, *rows[k]) for k in range(page_no * size, min(2000, (page_no + 1) * size))]
    files = report.ranges.count()
    assert files > 3 and len(report.page(66, 30).select(F.input_file_name()).distinct().collect()) <= 2
    assert RangedReport(df.where("v < 0"), [F.col("v").asc()]).page(0, 10).count() == 0


def test_feed_reads_only_the_buckets_of_its_keys(spark, monkeypatch):
    """A later drop with two keys looks at their buckets of the store, and drops repeats however late."""
    import os
    import tempfile

    from upkeep.streaming import feeds
    d, run = tempfile.mkdtemp(), os.path.basename(tempfile.mkdtemp())
    schema = "id long, ts timestamp, v string"

    def drop(name, rows):
        spark.createDataFrame(rows, "id long, day int, v string").selectExpr("id", "timestamp_seconds(day * 86400) AS ts", "v").write.parquet(f"{d}/{name}")
        return sorted(map(str, (tuple(r)[::2] for r in feeds.dedup_feed(spark, f"{d}/*", schema, "id", "ts", run_id=run, buckets=16).collect())))

    first = drop("one", [(k, 10, "a") for k in range(200)] + [(None, 9, "n"), (None, 8, "m")])
    assert len(first) == 201 and "(None, 'm')" in first
    seen = []
    real = spark.read.schema(schema).__class__.parquet

    def watch(self, *paths, **kw):
        out = real(self, *paths, **kw)
        if feeds.BUCKET in out.columns and "v" not in out.columns:
            seen.append(out)
        return out

    monkeypatch.setattr(spark.read.__class__, "parquet", watch)
    assert drop("two", [(7, 1, "late"), (7, 1, "late"), (1000, 1, "new"), (None, 1, "x")]) == sorted([*first, "(1000, 'new')"])
    assert len(seen) == 1
