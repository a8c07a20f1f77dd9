"""Service-order status and de-duplication for display.

* effective status: in the all-months scope an open row counts as completed
  when the same work (asset + description key, hard or soft) was completed in
  any export, or the asset has a later completion; in a one-month scope a
  completion after the month's end reads as still scheduled.
* prior open stubs: in the all-months scope, open rows of earlier months drop.
* stale-duplicate collapse: within (asset, description key, scheduled month),
  a group holding both open and completed rows keeps only its best row.

Skew: nothing here puts a whole group into one task. Group statistics are
aggregates with a map-side phase; rows are matched back to them with equi
joins, which AQE splits when a key is hot. No window spans a group. Only rows
that a rule can change, open rows and the groups that hold one, are looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.functions import attach_one_row

from upkeep.functions import month_key, next_month_start, norm_desc, norm_equip_id, soft_norm_desc, strip_ws
from upkeep.params import Params
from upkeep.session import materialize


def raw_status(c="status"):
    return F.when(F.lower(strip_ws(F.coalesce(F.col(c), F.lit("")))) == "completed",
                  F.lit("Completed")).otherwise(F.lit("Scheduled"))


def effective_status_all(svc: DataFrame, catalog: DataFrame, id_col: str = "equip_id") -> DataFrame:
    """All-months effective status; ``catalog`` is the unscoped service table, which holds
    the rows of ``svc``. Rows without an id (null or blank) keep their own status: they
    share no asset.

    A completed row is its own evidence, so only open rows ask the catalogue: they are
    reduced to (id, hard key, soft key), and of the completions only those of their ids
    are keyed and grouped."""
    key = norm_equip_id(id_col)
    hard, soft = norm_desc("description"), soft_norm_desc("description")
    named = key != ""
    dated = F.col("completed_date").isNotNull() & F.col("month_key").isNotNull()
    own = dated & named
    open_rows = svc.where(~dated & named).withColumn("_idn", key).withColumn("_hk", hard).withColumn("_sk", soft)
    # written, so the planner knows how few they are
    asked = materialize(open_rows.select("_idn", "_hk", "_sk").distinct())
    ids = asked.select("_idn").distinct()
    cat = catalog.where(F.col("month_key").isNotNull() & F.col("completed_date").isNotNull()) \
                 .select(key.alias("_id"), "description", "completed_date").where(F.col("_id") != "")
    cat = cat.join(ids, F.col("_id") == F.col("_idn"), "left_semi")
    done = materialize(cat.groupBy("_id", "description").agg(F.min("completed_date").alias("_first"))
                       .groupBy("_id", hard.alias("_h"), soft.alias("_s")).agg(F.min("_first").alias("_first")))
    keys = done.select("_id", F.explode(F.array_distinct(F.array("_h", "_s"))).alias("_k")).distinct()
    first_done = done.groupBy(F.col("_id").alias("_id3")).agg(F.min("_first").alias("_first_done"))
    hk = keys.select(F.col("_id").alias("_id1"), F.col("_k").alias("_hk1"), F.lit(True).alias("_hit_h"))
    sk = keys.select(F.col("_id").alias("_id2"), F.col("_k").alias("_sk2"), F.lit(True).alias("_hit_s"))
    told = (asked.join(hk, (asked._idn == hk._id1) & (asked._hk == hk._hk1), "left").join(sk, (asked._idn == sk._id2) & (asked._sk == sk._sk2), "left")
            .join(first_done, asked._idn == first_done._id3, "left")
            .select(F.col("_idn").alias("_i"), F.col("_hk").alias("_h"), F.col("_sk").alias("_s"),
                    F.coalesce(F.col("_hit_h"), F.col("_hit_s"), F.lit(False)).alias("_hit"), "_first_done"))
    j = open_rows.join(told, (F.col("_idn") == F.col("_i")) & (F.col("_hk") == F.col("_h")) & (F.col("_sk") == F.col("_s")), "left")
    completed = F.coalesce(F.col("_hit"), F.lit(False)) | F.coalesce(F.col("_first_done") > F.col("sched_date"), F.lit(False))
    judged = j.withColumn("status", F.when(completed, F.lit("Completed")).otherwise(raw_status())).select(*svc.columns)
    rest = svc.where(~named | own).withColumn("status", F.when(own, F.lit("Completed")).otherwise(raw_status())).select(*svc.columns)
    return rest.unionByName(judged)


def effective_status_month(svc: DataFrame, month: str) -> DataFrame:
    """One-month effective status: completed on/after the next month's first day -> Scheduled."""
    bound = next_month_start(F.lit(month))
    late = F.col("completed_date").isNotNull() & (F.col("completed_date") >= bound)
    return svc.withColumn("status", F.when(late, F.lit("Scheduled")).otherwise(raw_status()))


def drop_prior_open_stubs(svc: DataFrame, catalog: DataFrame) -> DataFrame:
    """Drop open rows of months before the latest month of the catalog."""
    latest = catalog.where(F.col("month_key").isNotNull()).agg(F.max("month_key").alias("_latest"))
    j = attach_one_row(svc, latest)
    prior_open = F.col("completed_date").isNull() & (F.col("month_key") < F.col("_latest"))
    return j.where(~F.coalesce(prior_open, F.lit(False))).drop("_latest")


def collapse_stale_duplicates(svc: DataFrame, soft: bool = False, id_col: str = "equip_id",
                              order_col: str = "row_ord") -> DataFrame:
    """Within (id, description key, scheduled month): if the group mixes open and
    completed rows, keep its best row by (has completion, status Completed,
    completion date, scheduled date), earliest row on ties; else keep all.

    A mixed group's best row is a completed one, so its winner is sought among the
    completed rows of groups that hold an open row (``min_by`` over the negated rank,
    then row order); one join back keeps the rows. Keys are worked out once and written,
    winners too, so the planner knows how few they are. All of it is shuffle operators
    AQE can split, so a hot group never has to fit one task."""
    key = soft_norm_desc("description") if soft else norm_desc("description")
    s = materialize(svc.withColumn("_dk", key).withColumn("_dm", F.coalesce(month_key("sched_date"), F.lit(""))))
    far = F.lit("0001-01-01").cast("date")
    neg_rank = F.struct((-(F.lower(strip_ws(F.col("status"))) == "completed").cast("int")).alias("b"),
                        (-F.unix_date(F.col("completed_date"))).alias("c"),
                        (-F.unix_date(F.coalesce(F.col("sched_date"), far))).alias("d"),
                        F.col(order_col).alias("o"))
    gkey = [id_col, "_dk", "_dm"]
    opened = materialize(s.where(F.col("completed_date").isNull()).select(*[F.col(c).alias("_o" + c) for c in gkey]).distinct())
    done = s.where(F.col("completed_date").isNotNull())
    mixed = done.join(opened, [done[c].eqNullSafe(opened["_o" + c]) for c in gkey], "left_semi")
    stale = materialize(mixed.groupBy(*[F.col(c).alias("_s" + c) for c in gkey]).agg(F.min_by(F.col(order_col), neg_rank).alias("_win")))
    j = s.join(stale, [s[c].eqNullSafe(stale["_s" + c]) for c in gkey], "left").drop(*["_s" + c for c in gkey])
    keep = F.col("_win").isNull() | (F.col(order_col) == F.col("_win"))
    return j.where(keep).drop("_dk", "_dm", "_win")


def prepare_service_for_display(svc: DataFrame, month: str, catalog: DataFrame | None = None,
                                id_col: str = "equip_id") -> DataFrame:
    """Effective status, prior-stub drop (all months) and stale collapse.
    ``month`` is ``'ALL'`` or ``'YYYY-MM'``; ``svc`` is already month-scoped."""
    catalog = catalog if catalog is not None else svc
    if str(month).strip().upper() == "ALL":
        # the status looks at the catalogue only, so rows that drop needn't be judged
        s = effective_status_all(drop_prior_open_stubs(svc, catalog), catalog, id_col)
        return collapse_stale_duplicates(s, soft=True, id_col=id_col)
    s = effective_status_month(svc, month)
    return collapse_stale_duplicates(s, soft=False, id_col=id_col)


def done_with_turnaround(svc: DataFrame, calendar: DataFrame, params: Params = Params()) -> DataFrame:
    """Completed rows with both dates, completion not before schedule, plus
    ``turnaround_bd`` business days (rows whose span is unknown drop)."""
    from upkeep.operators.calendar import with_business_days
    done = svc.where((F.lower(strip_ws(F.col("status"))) == "completed") & F.col("sched_date").isNotNull()
                     & F.col("completed_date").isNotNull() & (F.col("completed_date") >= F.col("sched_date")))
    return with_business_days(done, "sched_date", "completed_date", "turnaround_bd", calendar, params) \
        .where(F.col("turnaround_bd").isNotNull())
