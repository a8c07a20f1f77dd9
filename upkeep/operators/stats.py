"""Exact medians by distributed selection.

``median()`` keeps every value of a group in one aggregation buffer, and a
window over a group's distinct values puts them all into one task. Here the
middle rank is narrowed down instead:

1. every group is reduced to a histogram of distinct values (partial aggregates,
   so a group with a third of all rows arrives pre-counted);
2. values fall into buckets of a monotone scale, each about 0.02 % of its value
   wide, and only the bucket that holds the middle rank is kept, two for an even
   count whose middle values lie apart;
3. what is left, the values of that bucket, is read off by running counts.

Windows see a group's buckets and the values of one bucket, not its distinct
values. The scale is monotone, which is all that exactness needs; a value equal
to many others is one value. Values that crowd into a few buckets (all within
0.02 % of each other) meet in the last window, which sorts and spills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINE = 4096   # buckets for a growth of the value by a factor e


def _bucket(v: Column) -> Column:
    """Monotone in ``v``: about equal widths around zero, equal ratios beyond."""
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * FINE)).cast("int")


def exact_median(df: DataFrame, group_cols: Sequence[str], value_col: str, out: str = "median",
                 count_out: str | None = None) -> DataFrame:
    """One row per group with the exact median of non-null ``value_col``
    (mean of the two middle values for an even count) and optionally the count.
    NaN is the greatest value; without ``group_cols`` an input without values gives
    one row with a null."""
    g = list(group_cols)
    keys = [f"_g{i}" for i in range(len(g))] or ["_g"]
    named = [F.col(c).alias(k) for c, k in zip(g, keys)] or [F.lit(0).alias("_g")]
    hist = (df.where(F.col(value_col).isNotNull()).select(*named, F.col(value_col).cast("double").alias("_v"))
            .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    odd = F.isnan("_v") | (F.abs("_v") == float("inf"))
    # values that are no finite number have buckets of their own at the ends
    hist = hist.withColumn("_b", F.when(~odd, _bucket(F.col("_v"))).when(F.col("_v") == float("-inf"), -(1 << 30)).when(F.isnan("_v"), (1 << 30) + 1).otherwise(1 << 30))
    buckets = hist.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    buckets = buckets.withColumn("_all", F.sum("_n").over(w)).withColumn("_before", upto - F.col("_n"))
    buckets = buckets.withColumn("_k1", F.floor((F.col("_all") + 1) / 2)).withColumn("_k2", F.floor(F.col("_all") / 2) + 1)
    holds = [(F.col(k) > F.col("_before")) & (F.col(k) <= F.col("_before") + F.col("_n")) for k in ("_k1", "_k2")]
    kept = buckets.where(holds[0] | holds[1]).select(*[F.col(k).alias("_j" + k) for k in (*keys, "_b")], "_all", "_k1", "_k2", "_before")
    # null-safe for buckets too, though they are never null: an inferred not-null test would move into
    # one of the two readings of the histogram, and the rows would be read and reduced twice
    same = F.col("_b").eqNullSafe(F.col("_j_b"))
    for k in keys:  # groups may be null
        same = same & F.col(k).eqNullSafe(F.col("_j" + k))
    run = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    last = hist.join(kept, same).withColumn("_cum", F.col("_before") + F.sum("_c").over(run))

    def at(rank: str) -> Column:
        # the least value that the running count reaches the rank with, in the bucket that holds it
        return F.min(F.when((F.col("_cum") >= F.col(rank)) & (F.col("_cum") - F.col("_c") < F.col(rank)), F.col("_v")))

    aggs = [((at("_k1") + at("_k2")) / 2.0).alias(out)]
    if count_out:
        aggs.append(F.max("_all").alias(count_out))
    if not g:
        return last.agg(*aggs)
    return last.groupBy(*keys).agg(*aggs).withColumnsRenamed(dict(zip(keys, g))).select(*g, out, *([count_out] if count_out else []))
