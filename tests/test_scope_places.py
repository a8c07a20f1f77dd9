"""Building scope and hours per building normalise each location text once."""

from pyspark.sql import functions as F

from upkeep.operators import metrics, scope
from upkeep.session import materialize


def test_scope_asks_per_place(spark, monkeypatch):
    sizes = []

    def counted(df):
        out = materialize(df)
        sizes.append(out.count())
        return out
    monkeypatch.setattr(scope, "materialize", counted, raising=False)
    places = ["Hall A", " hall  a", "Hall B", None, ""]
    df = spark.range(500).select("id", F.element_at(F.array(*[F.lit(p) for p in places]), (F.col("id") % 5 + 1).cast("int")).alias("location"))
    users = spark.createDataFrame([("u1", "HALL A"), ("u1", "Hall A"), ("u2", "Hall B")], "user_id string, building string")
    norm = {r.location: r.b for r in df.select("location", scope.normalize_building("location").alias("b")).distinct().collect()}
    wanted = {r.b for r in users.where("user_id = 'u1'").select(scope.normalize_building("building").alias("b")).collect()}
    got = scope.building_scope(df, users, "u1")
    assert got.columns == df.columns
    assert {r.id for r in got.collect()} == {i for i in range(500) if norm[places[i % 5]] in wanted} != set()
    assert sizes and max(sizes) <= 2      # allowed places, not rows
    assert scope.building_scope(df, users, "nobody").count() == 500


def test_hours_per_building_are_summed_per_place_first(spark):
    rep = spark.createDataFrame([("Hall A", 1.0), (" Hall A ", 2.0), (None, 4.0), ("", 8.0)], "location string, hours double")
    out = metrics.hours_by_building(rep)
    assert {r.repair_hours for r in out.collect()} == {3.0, 12.0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2
