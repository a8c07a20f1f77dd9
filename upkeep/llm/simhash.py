"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprint: the words of the text (A-Z lower-cased, split at ASCII white space)
give shingles, repeats included; a fingerprint bit is 1 if it is set in over
half of the shingles' XXH64 values (seed 42). Fewer words than a shingle: the
whole sequence is the only shingle; no words: fingerprint zero.

Search: bit i carries a non-zero vector phi(i) of radius + 1 bits. For each
non-zero v, a mask keeps the bits with <phi(i), v> = 1. Any ``radius`` bits span
less than the whole space, so some v is orthogonal to all of them: two
fingerprints that differ in at most ``radius`` bits are equal under that mask,
without exception. Each mask is one hash table over the distinct fingerprints.

Buckets are counted first, with map-side combining. Buckets of two are checked
as they are; larger ones up to ``bucket_limit`` are gathered and reduced to a
spanning forest of their links; beyond that a bucket is hashed again with the
covering masks of its free bits, which keeps the guarantee and halves the free
bits each time (after two levels a bucket can hold 2^8 fingerprints at most).

Cases: null text counts as empty; rows with a null id are kept and linked, but a
component is named by its smallest id that is not null (null if it has none);
repeated rows link to each other; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import written
from upkeep.llm.components import connected_components

BITS = 64
SEED = 42
BUCKET_LIMIT = 2048
_SLICE = 1 << 15  # shingles whose bits are unpacked at a time


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(words_per_shingle)))))
    n = len(shingles)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, _SLICE):
        ones += np.unpackbits(h[k:k + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, _fp`` (the fingerprint as a signed long) and the ``carry`` struct."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"),
                       *([F.struct(*carry).alias("_carry")] if carry else []))

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, words_per_shingle) for t in b.column("_text").to_pylist()]
            arrays = [b.column("doc_id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))]
            names = ["doc_id", "_fp"]
            if carry:
                arrays.append(b.column("_carry"))
                names.append("_carry")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = rows.drop("_text").select("doc_id", F.lit(0).cast("long").alias("_fp"), *(["_carry"] if carry else [])).schema
    return rows.mapInArrow(run, schema)


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks over the given bit positions (unsigned). The
    first bits carry the unit vectors, so with more than ``radius`` positions no
    mask is empty."""
    top = 1 << (radius + 1)
    vectors = [1 << k for k in range(radius + 1)] + [v for v in range(1, top) if v & (v - 1)]
    phi = {b: vectors[k % len(vectors)] for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (phi[b] & v).bit_count() & 1) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Star edges (smallest member, member) of the link components of a bucket."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    open_, edges = np.ones(len(fps), dtype=bool), []
    for i in range(len(fps)):
        if not open_[i]:
            continue
        seen = front = np.arange(len(fps)) == i
        while front.any():
            front = near[front].any(axis=0) & ~seen
            seen = seen | front
        open_ &= ~seen
        own = fps[seen].view(np.int64)
        edges += [(int(own.min()), int(x)) for x in own if x != own.min()]
    return edges


def links(fps: DataFrame, radius: int, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``_fp``) that connect
    exactly the fingerprints within ``radius`` bits, directly or over others."""
    bucket_limit = max(bucket_limit, 1 << (radius + 1))  # a larger bucket has free bits left to split by
    masks = [_signed(m) for m in covering_masks(list(range(BITS)), radius)]
    rows = fps.select("_fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("_mask"))
    found = None
    while True:
        keyed = rows.withColumn("_key", F.col("_fp").bitwiseAND(F.col("_mask")))
        buckets = written(keyed.groupBy("_mask", "_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_fp").alias("a"),
                                                              F.max("_fp").alias("b")).where("_n > 1"), "buckets")
        two = buckets.where("_n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
        some = buckets.where(f"_n > 2 and _n <= {bucket_limit}").select(F.col("_mask").alias("_m"), F.col("_key").alias("_k"))
        members = (keyed.join(some, (F.col("_mask") == F.col("_m")) & (F.col("_key") == F.col("_k")))
                   .groupBy("_mask", "_key").agg(F.collect_list("_fp").alias("fps")).select("fps"))

        def run(batches):
            for batch in batches:
                edges = [e for fps in batch.column("fps").to_pylist() for e in _forest(np.array(fps, dtype=np.int64).view(np.uint64), radius)]
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

        here = two.unionByName(members.mapInArrow(run, "a long, b long"))
        found = here if found is None else found.unionByName(here)
        large = buckets.where(f"_n > {bucket_limit}").select(F.col("_mask").alias("_m"), F.col("_key").alias("_k"))
        if large.isEmpty():
            return found.distinct()
        again = keyed.join(large, (F.col("_mask") == F.col("_m")) & (F.col("_key") == F.col("_k"))).select("_fp", "_mask")

        def split(batches):
            cache: dict[int, np.ndarray] = {}
            for batch in batches:
                for fp, mask in zip(batch.column("_fp").to_pylist(), batch.column("_mask").to_pylist()):
                    if mask not in cache:
                        free = [i for i in range(BITS) if not mask >> i & 1]
                        cache[mask] = np.array(sorted({_signed((mask & (2 ** 64 - 1)) | m) for m in covering_masks(free, radius)}), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cache[mask]), fp)), pa.array(cache[mask])], ["_fp", "_mask"])

        rows = written(again.mapInArrow(split, "_fp long, _mask long").distinct(), "split")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, radius: int = 4, id_col: str = "doc_id",
                    text_col: str = "text", carry: tuple[str, ...] = (), bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id, _rid`` (row id),
    ``_root`` (the component's smallest fingerprint) and the ``carry`` struct."""
    marked = written(fingerprints(docs, words_per_shingle, id_col, text_col, carry)
                     .withColumn("_rid", F.monotonically_increasing_id()), "fingerprints")
    classes = written(marked.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "classes")
    root = connected_components(written(links(classes.select("_fp"), radius, bucket_limit), "links"), "a", "b")
    rooted = (classes.join(root, F.col("_fp") == F.col("node"), "left")
              .select(F.col("_fp").alias("_f"), "_least", F.coalesce("root", "_fp").alias("_root")))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id")).withColumnRenamed("_root", "_r")
    named = rooted.join(least, F.col("_root") == F.col("_r")).select("_f", "_root", "component_id")
    named = written(named, "named")
    return marked.join(named, F.col("_fp") == F.col("_f")).select(
        "doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id", "_rid", "_root",
        *(["_carry"] if carry else []))


def all_but_one(near: DataFrame) -> DataFrame:
    """The rows that go: of each component the smallest document stays; of
    repeated rows with that id the first."""
    first = near.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("_root").agg(F.min("_rid").alias("_first"))
    return near.join(first.select("_first"), F.col("_rid") == F.col("_first"), "left_anti")
