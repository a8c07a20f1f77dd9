"""Service cleaning keeps little on disk: line items are joined once, the raw grid isn't staged,
shuffle files of finished writes go, and only buckets without a header ask for a carry."""

import random
import time

import pytest
from pyspark.sql import functions as F

from upkeep.operators import windows
from upkeep.operators.windows import forward_fill
from upkeep.plans import jobs
from upkeep.session import materialize, small
from upkeep.sources import bench, raw_grid

SF = "/root/testdata/sf0.001"


def _counted(monkeypatch, module, name="materialize"):
    seen, real = [], getattr(module, name)

    def call(df, *a, **b):
        out = real(df, *a, **b)
        seen.append(out)
        return out
    monkeypatch.setattr(module, name, call)
    return seen


def test_line_items_are_joined_once(spark):
    """Five kinds of export rows come from one written table: none scans or joins the line items again."""
    plan = bench.service_export_grid(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "orders.parquet" not in plan


def test_grid_is_not_staged(spark, monkeypatch):
    seen, staged = _counted(monkeypatch, jobs), _counted(monkeypatch, raw_grid)
    jobs.clean_service_grid(bench.service_export_grid(spark, SF), detail_bucket_rows=bench.DETAIL_BLOCK)
    # headers of the files, and the parsed rows
    assert [("cells" in df.columns, "_eid" in df.columns) for df in seen] == [(False, False), (False, True)] and not staged


def test_shuffles_of_a_write_go(spark, tmp_path):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for x in (files.apply(i).getName() for i in range(files.size())) if x.startswith("shuffle")}
    df = spark.range(200_000).repartition(7, "id").groupBy((F.col("id") % 5000).alias("k")).agg(F.sum("id").alias("s"))
    before = shuffles()
    df.write.parquet(str(tmp_path / "plain"))
    plain = shuffles()
    assert plain - before
    out = materialize(df)
    for _ in range(40):  # they are removed in the background
        if not shuffles() - plain:
            break
        time.sleep(0.25)
    assert not shuffles() - plain and out.count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _brute(rows):
    """(part, no) -> carried values of rows (part, no, id, value)."""
    out, last = {}, {}
    for p, n, i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        if i is not None:
            last[p] = (i, v, n)
        out[p, n] = last.get(p, (None, None, None))
    return out


@pytest.mark.parametrize("bucket, share", [(1, .3), (4, .1), (7, .5), (1000, .2), (5, 0.0), (5, 1.0)])
def test_forward_fill_against_a_scan(spark, bucket, share):
    rnd = random.Random(bucket)
    rows = [(p, n, f"{p}{n}" if rnd.random() < share else None, rnd.choice([None, n])) for p in "abc" for n in rnd.sample(range(300), 90)]
    df = spark.createDataFrame(rows, "part string, no long, id string, v long")
    want = _brute(rows)
    out = forward_fill(df, ["part"], "no", F.col("id").isNotNull(), ["id", "v"], bucket_rows=bucket, prefix="c_").collect()
    assert len(out) == len(rows) and {(r.part, r.no): (r.c_id, r.c_v, r.c_no) for r in out} == want
    assert out[0].asDict().keys() == {"part", "no", "id", "v", "c_id", "c_v", "c_no"}
    # only the rows and columns asked for; the others still carry
    some = forward_fill(df, ["part"], "no", F.col("id").isNotNull(), ["id", "v"], bucket_rows=bucket, prefix="c_", rows=F.col("no") % 3 == 0, keep=["no", "part"])
    assert some.columns == ["no", "part", "c_id", "c_v", "c_no"]
    assert {(r.part, r.no): (r.c_id, r.c_v, r.c_no) for r in some.collect()} == {k: x for k, x in want.items() if k[1] % 3 == 0}


def test_no_carry_where_buckets_begin_with_a_header(spark, monkeypatch):
    rows = [("f", n, f"h{n}" if n % 10 == 0 else None) for n in range(200)]
    df = spark.createDataFrame(rows, "file string, no long, id string")
    seen = _counted(monkeypatch, windows)
    out = forward_fill(df, ["file"], "no", F.col("id").isNotNull(), ["id"], bucket_rows=10)
    assert {r.no: r.ctx_id for r in out.collect()} == {n: f"h{n // 10 * 10}" for n in range(200)}
    assert len(seen) == 1 and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    # one bucket without a header: it alone asks
    seen.clear()
    out = forward_fill(df.where("no != 50"), ["file"], "no", F.col("id").isNotNull(), ["id"], bucket_rows=10)
    assert {r.ctx_id for r in out.where("no between 50 and 59").collect()} == {"h40"}
    assert [df.count() for df in seen] == [199, 1]


def test_broadcast_of_small_tables_only(spark):
    big = spark.range(100)
    plan = lambda dim: big.join(dim, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(small(spark.range(10), 10)) and "broadcast" not in plan(small(spark.range(11), 10))
