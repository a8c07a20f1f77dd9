"""Physical-plan checks for the scale claims: no Python in the query plans, no
cross / nested-loop joins, one shuffle for the flagship rollup, pruned scans."""

import pytest

import __spark_entry__ as E
from upkeep.plans import catalog

SF = "/root/testdata/sf0.001"
STREAMING = {"stream_daily_volume", "stream_dedup_feed"}  # results are read back from their sink


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(k for k in E.queries() if k not in STREAMING))
def test_no_python_and_no_cross_join(spark, name):
    p = plan_text(E.queries()[name](spark, SF))
    python = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas")
    # the maintenance engine's own queries; the removable ones may use Arrow batches
    for bad in python if hasattr(catalog, f"q_{name}") else ():
        assert bad not in p, f"{name}: {bad} in plan"
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{name}: {bad} in plan"


def test_flagship_single_shuffle_and_pruned_scan(spark):
    df = E.queries()["replacement_status"](spark, "/root/testdata/sf0.01")
    df.write.format("noop").mode("overwrite").save()
    p = df._jdf.queryExecution().executedPlan().toString()
    # the only repartitioning shuffle is the rollup on the asset id
    assert p.count("Exchange hashpartitioning") == 1
    assert "l_tax" not in p and "l_returnflag" not in p  # lineitem scan reads only used columns


def test_catalog_match_has_no_pair_explosion(spark):
    p = plan_text(E.queries()["catalog_match"](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
