"""Mixing sources to target weights with a Pfair schedule.

Each source is laid out as a line of blocks of ``block_chars`` characters: a
document belongs to the block that its running character count falls in. Block j
(from 1) of a source with the share w of all weights is released at slot
floor((j-1)/w) and due at ceil(j/w); each slot goes to the released block with
the earliest deadline. Weights are taken as exact rationals and never rounded:
the shares add up to one, so every deadline is met, and in every prefix of the
schedule, however long, each source is less than one block away from the weight
asked for. Sources of equal weight are scheduled as one, and its slots go round
them in turn: with m of them, the y-th slot (from 0) is block y div m of member
y mod m, which is as near to its weight as the whole is. So the schedule holds
one entry per different weight, not per source; by default these are at most the
different block counts, about the square root of twice the blocks. It is worked
out slot by slot over its whole length and handed on ``period`` slots at a time;
that bounds memory and changes no slot.

The mix ends with the slot in which the last source has been used whole: the
source that is largest against its weight appears once, the others start over
(their last round may stop short there). No document is
left out. Default weights are the number of blocks to the power ``temperature``,
the usual smoothing; a dictionary of weights replaces it (sources that it does
not name get the smallest named weight). Weights must be positive and finite, as
no finite mix uses every document of a source without weight; a source with a
small weight for its blocks makes the mix as long as its weight asks.

Cases: a null source is a source of its own; a null text has no characters;
null and repeated ids are kept (rows are told apart by a row id); a text longer
than a block covers several slots, of which it starts in the first; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import operator
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import prefix_sums, written

BLOCK_CHARS = 32_768
PERIOD = 16_384
TEMPERATURE = 0.7


def whole(weights: list[float]) -> list[int]:
    """Integers in exactly the proportions of the weights."""
    if not all(w > 0 and math.isfinite(w) for w in weights):
        raise ValueError("weights must be positive and finite")
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(x.denominator for x in exact))
    return [int(x * scale) for x in exact]


def pfair(weights: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block from 0, release, deadline, slot) without end, by earliest
    deadline first among the released blocks."""
    total = sum(weights)
    waiting = [(0, -(-total // w), i, 1) for i, w in enumerate(weights)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            release, deadline, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, i, j, release))
        deadline, i, j, release = heapq.heappop(ready)
        yield i, j - 1, release, deadline, slot
        heapq.heappush(waiting, (j * total // weights[i], -(-(j + 1) * total // weights[i]), i, j + 1))
        slot += 1


def pfair_period(counts: list[int]) -> list[tuple[int, int, int, int, int]]:
    """The schedule of one period of as many slots as the counts add up to."""
    return list(islice(pfair(counts), sum(counts)))


def until_used(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """The schedule up to the slot in which the last source has been used whole."""
    left = len(blocks)
    for row in pfair(weights):
        yield row
        left -= row[1] + 1 == blocks[row[0]]
        if not left:
            return


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE,
        block_chars: int = BLOCK_CHARS, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per scheduled document: ``_rid`` (row id), ``doc_id, source, block``
    (of its source), ``epoch`` (0: first use), ``release, deadline, slot`` and
    ``place`` (characters of the source before it); ``_carry``: a struct of the
    ``carry`` columns, where asked for. Order: slot, place."""
    spark = docs.sparkSession
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                               F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("_len"),
                               *([F.struct(*carry).alias("_carry")] if carry else []))
                   .withColumn("_rid", F.monotonically_increasing_id()), "mix")
    # a hash decides the order inside a source, so neighbours in the input are spread out
    laid = prefix_sums(rows.withColumn("_order", F.xxhash64("_rid")), ["source"], ["_order", "_rid"], "_len", "place", "laid")
    blocked = laid.withColumn("block", F.floor(F.col("place") / block_chars))
    sizes = blocked.groupBy("source").agg((F.max("block") + 1).alias("_blocks"))

    if weights:
        named = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "_n string, _named double")
        weighed = (sizes.join(named, F.col("source").eqNullSafe(F.col("_n")), "left")
                   .select("source", "_blocks", F.coalesce("_named", F.lit(float(min(weights.values())))).alias("_w")))
    else:
        weighed = sizes.withColumn("_w", F.pow("_blocks", F.lit(float(temperature))))
    members = written(prefix_sums(weighed.withColumn("_one", F.lit(1)), ["_w"], ["source"], "_one", "_member", "members")
                      .select("source", "_blocks", "_w", F.col("_member").cast("long").alias("_member")), "weights")
    kinds = members.groupBy("_w").agg(F.count(F.lit(1)).alias("_members"), F.max(F.struct("_blocks", "_member")).alias("_last"))

    def schedule(batches):
        """One row per different weight in, the slots of the whole schedule out."""
        got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["_w"])
        if not got:
            return
        single, m = whole([r["_w"] for r in got]), [r["_members"] for r in got]
        total = sum(map(operator.mul, single, m))
        # of the sources of a weight, the last one with the most blocks is the last used whole
        slots = until_used([w * n for w, n in zip(single, m)],
                           [(r["_last"]["_blocks"] - 1) * r["_members"] + r["_last"]["_member"] + 1 for r in got])
        while part := list(islice(slots, period)):
            rows = [(got[i]["_w"], y % m[i], j := y // m[i], j * total // single[i], -(-(j + 1) * total // single[i]), slot)
                    for i, y, _, _, slot in part]
            types = [pa.float64()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), types)],
                                             ["_w", "_member", "_j", "_release", "_deadline", "_slot"])

    plan = written(kinds.coalesce(1).mapInArrow(
        schedule, "_w double, _member long, _j long, _release long, _deadline long, _slot long"), "schedule")
    per_source = (members.join(plan.groupBy("_w", "_member").agg((F.max("_j") + 1).alias("_uses")), ["_w", "_member"])
                  .withColumnRenamed("source", "_s"))
    used = (blocked.join(per_source, F.col("source").eqNullSafe(F.col("_s")))
            # the source's j-th block in the schedule is block j mod blocks: one use per turn
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"),
                                                      F.floor((F.col("_uses") - 1 - F.col("block")) / F.col("_blocks")))))
            .withColumn("_j", F.col("epoch") * F.col("_blocks") + F.col("block"))
            .drop("_s", "_blocks", "_uses"))
    return used.join(plan, ["_w", "_member", "_j"]).select(
        "_rid", "doc_id", "source", "block", "epoch", F.col("_release").alias("release"),
        F.col("_deadline").alias("deadline"), F.col("_slot").alias("slot"), "place", *(["_carry"] if carry else []))
