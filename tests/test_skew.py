"""Hot keys: one id holds a third of all rows. Operators built for skew (partial
aggregates, group statistics + joins, histogram medians) must still give the
brute-force answer."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from upkeep.operators.rollup import asset_rollup
from upkeep.operators.service_scope import collapse_stale_duplicates
from upkeep.operators.stats import exact_median
from upkeep.operators.windows import latest_per_key

N = 30000


def _rows():
    rnd = random.Random(7)
    out = []
    for i in range(N):
        eid = 0 if i % 3 == 0 else rnd.randint(1, 500)
        sched = dt.date(2026, 1, 1) + dt.timedelta(days=rnd.randint(0, 59))
        done = sched + dt.timedelta(days=rnd.randint(0, 9)) if rnd.random() < 0.5 else None
        out.append((eid, f"job {rnd.randint(0, 3)}", sched, done, "Completed" if done else "Scheduled",
                    round(rnd.random() * 10, 2), i))
    return out


def test_hot_key_operators_match_pandas(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "equip_id int, description string, sched_date date, completed_date date, "
                                     "status string, parts double, row_ord int")
    pdf = pd.DataFrame(rows, columns=["equip_id", "description", "sched_date", "completed_date", "status",
                                      "parts", "row_ord"])
    # rollup: sums and first description per id
    got = {r.equip_id: (r.description, round(r.parts, 6), r.n_rows)
           for r in asset_rollup(df, firsts=("description",), sums=("parts",)).collect()}
    exp = {k: (g.sort_values("row_ord").description.iloc[0], round(g.parts.sum(), 6), len(g))
           for k, g in pdf.groupby("equip_id")}
    assert got == exp
    # latest completion per id, earliest row on ties, nulls last
    lat = {r.equip_id: r.row_ord for r in latest_per_key(df, "equip_id", "completed_date").collect()}
    def pick(g):
        g = g.assign(n=g.completed_date.isna()).sort_values(["n", "completed_date", "row_ord"],
                                                            ascending=[True, False, True])
        return int(g.row_ord.iloc[0])
    assert lat == {k: pick(g) for k, g in pdf.groupby("equip_id")}
    # stale collapse: groups mixing open and completed rows keep one row
    kept = collapse_stale_duplicates(df.withColumn("month_key", F.date_format("sched_date", "yyyy-MM"))).count()
    exp_kept = 0
    for _, g in pdf.assign(m=pdf.sched_date.map(lambda d: d.strftime("%Y-%m"))).groupby(
            ["equip_id", "description", "m"]):
        nd = g.completed_date.notna().sum()
        exp_kept += 1 if 0 < nd < len(g) else len(g)
    assert kept == exp_kept
    # exact median per id
    med = {r.equip_id: r.m for r in exact_median(df, ["equip_id"], "parts", "m").collect()}
    assert med == {k: float(g.parts.median()) for k, g in pdf.groupby("equip_id")}


def test_median_of_a_hot_key_with_millions_of_distinct_values(spark):
    """One keyword holds a third of the rows, a million distinct prices; no window runs over them."""
    n = 3_000_000
    df = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 4000)).alias("k"),
                                        ((F.col("id") * 1_103_515_245) % 2_147_483_647 / 1000.0).alias("v"))
    got = exact_median(df, ["k"], "v", "m", "n").where("k = 'hot'").first()
    want = sorted(i * 1_103_515_245 % 2_147_483_647 / 1000.0 for i in range(0, n, 3))
    assert got.n == 1_000_000 and got.m == (want[499_999] + want[500_000]) / 2.0
    # rows that reach a window: buckets, and the values of the middle one
    import upkeep.operators.stats as stats
    hist = df.where("k = 'hot'").groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")).groupBy(stats._bucket(F.col("v")).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"))
    assert hist.count() < 70_000 and hist.where(F.col("low") <= got.m).orderBy(F.desc("low")).first().n < 1000


def test_median_of_awkward_values(spark):
    import math
    import statistics
    inf = math.inf
    groups = {"ties": [1.0] * 7, "even": [1.0, 2.0], "apart": [-1e300, 1e300], "near": [1.0, 1.0 + 2 ** -52, 1.0 + 2 ** -51, 1.0 + 2 ** -50], "neg": [-5.5, -3.25, 0.0, 2.0, 1e-300],
              "inf": [-inf, 1.0, inf], "one": [4.0], "wide": [10.0 ** k for k in range(-300, 300)], "small": [1e-9 * k for k in range(501)], None: [3.0, 9.0, 6.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("even", None), ("nothing", None)]
    got = {r.k: (r.m, r.n) for r in exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m", "n").collect()}
    assert got == {k: (statistics.median(vs), len(vs)) for k, vs in groups.items()}
    df = spark.createDataFrame(rows, "k string, v double")
    assert exact_median(df.where("k = 'even'"), [], "v", "m").collect()[0].m == 1.5 and exact_median(df.where("k = 'zz'"), [], "v", "m").collect()[0].m is None
    assert exact_median(spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v double"), [], "v", "m").first().m == 2.0
