"""Exact deduplication by distributed MSD radix partitioning.

The key of a document is its byte length followed by its normalised bytes. All
documents start in one class; each round splits every class by the next run of
key bytes (32, then 16 times as many each round). Classes of one document and
classes whose key has ended leave; the rest goes on with the remaining bytes.
Equality is decided by the bytes alone, never by a digest.

A round is one map-side pre-aggregated count per (class, byte run) and one join
of the members with the classes of two or more, which adaptive execution splits
when a class is hot: no task ever holds a whole class. The state between rounds
is a written table in the shared folder.

Cases: a null text counts as empty; empty texts form one class; a null id is
smaller than any id; of repeated rows with the largest id exactly one stays; an
empty table gives an empty result; extra columns are ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import ascii_lower, written

FIRST_BYTES = 32     # bytes compared in the first round, 8 of them the length
GROWTH = 16          # each round compares so many times the bytes of the last
MOST_BYTES = 1 << 21  # a round's run never gets longer than this


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: tuple[str, ...] = (), first_bytes: int = FIRST_BYTES,
                growth: int = GROWTH, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``
    and ``_carry`` (a struct of the ``carry`` columns, where asked for)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.lpad(F.hex(F.octet_length(text)), 8, "0")
    # a text's first bytes need only its first characters
    head = F.substring(F.concat(length, ascii_lower(F.substring(text, 1, first_bytes))).cast("binary"), 1, first_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), head.alias("_head"),
                       *([F.struct(*carry).alias("_carry")] if carry else []))
    # written, so that the join has an exchange of its own and a hot head can be split
    heads = written(rows.groupBy("_head").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                    .select(F.col("_head").alias("_h")), "heads")
    norm = ascii_lower(F.col("_text"))
    kept_cols = ["doc_id", "text_sha256", *(["_carry"] if carry else [])]
    first = (rows.join(heads.hint("shuffle_hash"), F.col("_head") == F.col("_h"), "left")
             .withColumn("_norm", norm)
             .select("doc_id", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
                     *(["_carry"] if carry else []),
                     F.when(F.col("_h").isNotNull(), F.lit(0)).cast("long").alias("_class"),
                     F.when(F.col("_h").isNotNull(), F.concat(length_of("_norm"), F.col("_norm")).cast("binary")).alias("_rest"),
                     F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"),
                     F.monotonically_increasing_id().alias("_rid")))
    state = written(first, "dedup")
    cols = ["_rid", *kept_cols, "keep_id", "group_size"]
    alone = [state.where("_rest is null").select(*cols)]
    ended = None
    step = first_bytes
    while True:
        live = state.where("_rest is not null").withColumn("_run", F.substring("_rest", 1, step))
        classes = written(live.groupBy("_class", "_run")
                          .agg(F.count(F.lit(1)).alias("_n"), F.max("doc_id").alias("_keep"), F.min("_rid").alias("_next"))
                          .where("_n > 1").withColumnsRenamed({"_class": "_c", "_run": "_r"}), "classes")
        goes_on = F.col("_n").isNotNull() & (F.length("_rest") > step)
        state = written(
            live.join(classes.hint("shuffle_hash"), (F.col("_class") == F.col("_c")) & (F.col("_run") == F.col("_r")), "left")
            .select("_rid", *kept_cols,
                    F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
                    F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
                    F.col("_next").alias("_class"),
                    F.when(goes_on, F.substring(F.col("_rest"), F.lit(step + 1), F.length("_rest"))).alias("_rest")),
            "dedup")
        done = state.where("_rest is null")
        alone.append(done.where("_class is null").select(*cols))
        whole = done.where("_class is not null")
        ended = whole if ended is None else ended.unionByName(whole)
        if state.where("_rest is not null").isEmpty():
            break
        step = min(step * growth, most_bytes)
    # of several rows with the class's largest id the first one read stays
    winner = written(ended.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("_class")
                     .agg(F.min("_rid").alias("_winner")).withColumnRenamed("_class", "_c"), "winners")
    copies = (ended.join(winner, F.col("_class") == F.col("_c"))
              .withColumn("kept", F.col("_rid") == F.col("_winner")).select(*cols, "kept"))
    out = copies
    for part in alone:
        out = out.unionByName(part.withColumn("kept", F.lit(True)))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *(["_carry"] if carry else []))


def length_of(name: str):
    return F.lpad(F.hex(F.octet_length(F.col(name))), 8, "0")
