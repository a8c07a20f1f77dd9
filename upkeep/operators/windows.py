"""Row-order operators: latest row per key, forward fill of header context,
row renumbering.

Skew: a key (an asset, a file, a conversation) may hold a third of all rows,
so none of these runs one window over a whole key.
* ``latest_per_key`` is a ``min_by`` aggregate (partial per task, then merged).
* ``forward_fill`` is a two-level scan: runs inside fixed-size buckets of the
  order column, plus a carry over one row per bucket for those that begin without a header.
* ``dense_number`` numbers range-sorted files by prefix sums of their counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upkeep.session import materialize, packed


def latest_per_key(df: DataFrame, key: str | Sequence[str], date_col: str, order_col: str = "row_ord") -> DataFrame:
    """One row per key: latest ``date_col`` (nulls last), earliest row on ties."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(F.col(date_col).isNull().alias("n"),
                    (-F.unix_date(F.col(date_col).cast("date"))).alias("d"),
                    F.col(order_col).alias("o"))
    if dict(df.dtypes)[date_col] == "timestamp":
        rank = F.struct(F.col(date_col).isNull().alias("n"),
                        (-F.unix_micros(F.col(date_col))).alias("d"), F.col(order_col).alias("o"))
    best = F.min_by(F.struct(*[F.col(c) for c in others]), rank).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def forward_fill(df: DataFrame, part_cols: Sequence[str], order_col: str, is_header, carry_cols: Sequence[str],
                 bucket_rows: int = 4096, prefix: str = "ctx_", rows=None, keep: Sequence[str] | None = None) -> DataFrame:
    """Rows where ``is_header`` holds set ``carry_cols`` for themselves and all
    following rows (by integer ``order_col`` within ``part_cols``) until the next
    header; all carried columns reset together. Rows before the first header
    get nulls. ``rows``: condition on ``df`` of the rows to return, else all;
    ``keep``: the columns of ``df`` to return, else all.

    Filled rows are written; only buckets that begin without a header ask the
    buckets before them, and where there is none no carry is computed."""
    parts, keep = list(part_cols), list(df.columns if keep is None else keep)
    header = F.struct(F.col(order_col).alias("_o"), *[F.col(c).alias(c) for c in carry_cols])
    dealt = df.withColumn("_bk", F.floor(F.col(order_col) / F.lit(bucket_rows)))
    # level 1: running last header inside each (partition, bucket): at most bucket_rows per window.
    # Rows are dealt first, so the header's values aren't shuffled a second time as a struct
    w = Window.partitionBy(*parts, "_bk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    d = dealt.repartition(*parts, "_bk").withColumn("_hdr", F.when(is_header, header))
    d = d.withColumn("_in", F.last("_hdr", ignorenulls=True).over(w))
    d = d if rows is None else d.where(rows)
    at = [F.col(c).alias(f"_p{i}") for i, c in enumerate(parts)]
    with packed(df.sparkSession):
        d = materialize(d.select(*[F.col(c).alias("_c_" + c) for c in keep], *at, "_bk", "_in"))
    filled, unfilled = d.where(F.col("_in").isNotNull()), d.where(F.col("_in").isNull())
    if unfilled.limit(1).count():
        # level 2: last header of each bucket, then carry = last header of earlier buckets
        ps = [f"_p{i}" for i in range(len(parts))]
        asking = materialize(unfilled.select(*ps, "_bk").distinct().withColumn("_asks", F.lit(True)))
        heads = dealt.where(is_header).select(*at, "_bk", header.alias("_last"))
        if ps:
            heads = heads.join(asking.select(*ps).distinct(), ps, "left_semi")
        heads = heads.groupBy(*ps, "_bk").agg(F.max_by("_last", "_last._o").alias("_last"))
        wb = Window.partitionBy(*ps).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
        carry = asking.join(heads, [*ps, "_bk"], "full").withColumn("_carry", F.last("_last", ignorenulls=True).over(wb))
        carry = carry.where("_asks").select(*ps, "_bk", "_carry")
        unfilled = unfilled.drop("_in").join(carry, [*ps, "_bk"], "left").withColumnRenamed("_carry", "_in")
        d = filled.unionByName(unfilled)
    out = [F.col("_c_" + c).alias(c) for c in keep] + [F.col("_in")[c].alias(prefix + c) for c in carry_cols]
    return d.select(*out, F.col("_in")["_o"].alias(prefix + order_col))


def dense_number(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str], out: str = "row_no",
                 count_out: str | None = None, start: int = 1) -> DataFrame:
    """``start``, ``start + 1``, ... within each ``by`` group in ``order`` (nulls first), after any shuffle;
    ``count_out`` adds the group's row count. ``by`` may be empty: the whole table is numbered.

    Rows are range-partitioned and sorted on (by, order) and written, so a hot group spreads over
    many files and every row has a fixed place in its file. Each (group, file) run is reduced to its
    row count and first place; runs get the exclusive prefix of the counts before them, and a row's
    number is that prefix plus its distance from the start of its run. No window spans data rows: the
    only one is over a group's runs, at most one a file. ``order`` should end in a unique column, else
    equal rows are numbered in any order."""
    by, order = ([c] if isinstance(c, str) else list(c) for c in (by, order))
    rows = _ranged(df, [F.col(c).asc_nulls_first() for c in by + order])
    ks = [f"_k{i}" for i in range(len(by))]
    runs = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(by, ks)], F.col("_file").alias("_f")) \
               .agg(F.min("_part").alias("_p"), F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*ks)
    before = group.orderBy("_p", "_f").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.select(*ks, "_f", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                                   F.sum("_n").over(group).alias("_all")))
    on = F.col("_file") == F.col("_f")
    for c, k in zip(by, ks):
        on = on & F.col(c).eqNullSafe(F.col(k))
    # every row has its run; the left join keeps the rows' side as the one that is streamed
    rows = rows.join(runs, on, "left").withColumn(out, F.col("_before") + F.col("_at") - F.col("_first") + start)
    if count_out:
        rows = rows.withColumn(count_out, F.col("_all"))
    return rows.drop("_part", "_file", "_at", "_f", "_first", "_before", "_all", *ks)


def _ranged(df: DataFrame, keys) -> DataFrame:
    """The rows range-partitioned, sorted and written: ``_part`` is the place of a row's
    range, ``_file`` and ``_at`` its file and place there."""
    placed = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    return placed.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))


class RangedReport:
    """A report sorted once, for reading pages of any depth.

    The sorted rows are written in ranges; the row counts of the ranges, summed up, tell
    which of them a page lies in, so a page reads those files only (their names prune the
    scan) and the rows before it are never read, however deep it is. ``keys`` are sort
    columns and should end in a unique one."""

    def __init__(self, df: DataFrame, keys):
        self.columns = df.columns
        self.rows = _ranged(df, list(keys))
        runs = self.rows.groupBy("_file").agg(F.min("_part").alias("_p"), F.count(F.lit(1)).alias("_n"))
        before = Window.orderBy("_p", "_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
        self.ranges = materialize(runs.select("_file", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))

    def page(self, page_no: int, size: int) -> DataFrame:
        """``place`` (from 0) and the report's columns of page ``page_no`` (from 0)."""
        first, last = page_no * size, (page_no + 1) * size
        hit = self.ranges.where((F.col("_before") < last) & (F.col("_before") + F.col("_n") > first)).collect()  # the page's ranges
        rows, place = self.rows.where(F.col("_file").isin([r["_file"] for r in hit])), F.lit(None).cast("long")
        for r in hit:
            place = F.when(F.col("_file") == r["_file"], F.col("_at") + r["_before"]).otherwise(place)
        return rows.withColumn("place", place).where((F.col("place") >= first) & (F.col("place") < last)).select("place", *self.columns)
