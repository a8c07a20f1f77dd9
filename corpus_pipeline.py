"""Corpus pipeline: five stages over ``documents``, each calling one operator.

Between stages the rows are written as Parquet in the shared folder and read
again. A stage's input is therefore a Parquet table, whose file names and row
numbers tell rows apart: the operators carry this key instead of the texts, and
the texts are joined with the decisions once. All stages but the last return the
columns of documents. The mix repeats
the documents of sources that are small against their weight, so from there on a
doc_id may occur more than once; its files hold the rows in schedule order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm import bpe, exact_dedup, mixing, simhash, toxicity
from upkeep.llm.common import table, written


KEY = ("_file", "_at")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with their place in the stage's Parquet input."""
    return docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    gone = dropped.select(F.col("_carry._file").alias("_f"), F.col("_carry._at").alias("_a"))
    return rows.join(gone, (F.col("_file") == F.col("_f")) & (F.col("_at") == F.col("_a")), "left_anti").drop(*KEY)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: rejected documents go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=tuple(docs.columns)).where("predicted = 0").select("_carry.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the largest doc_id stays."""
    rows = keyed(docs)
    return without(rows, exact_dedup.exact_dedup(rows, carry=KEY).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each component the smallest doc_id stays."""
    rows = keyed(docs)
    return without(rows, simhash.all_but_one(simhash.near_duplicates(rows, carry=KEY)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document, in the order and as often as the schedule says."""
    rows = keyed(docs)
    mixed = mixing.mix(rows, carry=KEY).select("slot", "place", F.col("_carry._file").alias("_f"), F.col("_carry._at").alias("_a"))
    placed = rows.join(mixed, (F.col("_file") == F.col("_f")) & (F.col("_at") == F.col("_a")))
    return placed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token counts and digests of the ids and of the decoded text."""
    return bpe.round_trip(docs, bpe.lexicon(docs))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies),
          ("source_mixing", mix_sources), ("bpe", encode)]

ORACLE_SQL = None  # a trained classifier, XXH64 fingerprints and BPE have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
