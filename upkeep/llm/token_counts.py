"""Token counts with overlap resynchronisation for huge documents.

A text of up to ``chunk_chars`` characters is counted as it is. A longer one is
cut into chunks that overlap by ``overlap`` characters and are dealt over all
tasks, each encoded by itself with the offsets of its tokens. Neighbours are
spliced in their overlap at the first boundary that both encodings have and that
is proven stable: a token that starts right after white space. (The tokenizer
drops white space, splits there before merging, never composes characters across
it, and no special token contains any, so the tokens after such a start don't
depend on what precedes it.) The left chunk counts its tokens before the
boundary, the right one those from it on. Where an overlap has no such common
boundary, the document is cut again with chunks and overlaps ``widen`` times as
long, until all its splices hold or it is one chunk.

Words of Latin letters are counted through a memory of the tokenizer library's
own counts per word (its merges never cross words); any other text, and any that
holds a special token's opening, is encoded by the library as a whole.

Cases: a null text counts as empty: no bytes, no tokens; ids may be null or
repeated, every row has a count; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CHUNK_CHARS = 65_536
OVERLAP = 512
WIDEN = 8
LIMIT = 2048
_CACHED = 400_000
# Latin letters whose lower case is one Latin letter again, without U+0130
_OTHER = re.compile("[^\x00-įı-ſ]")
_L, _N, _S = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


class Counter(dict):
    """word -> tokens, asked of the library once."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def __missing__(self, word: str) -> int:
        n = len(self.library.encode(word, add_special_tokens=False).ids)
        if len(word) < 200:
            if len(self) >= _CACHED:
                self.clear()
            self[word] = n
        return n

    @staticmethod
    def plain(text: str) -> bool:
        return (text.isascii() or not _OTHER.search(text)) and "<|" not in text

    def count(self, text: str) -> int:
        if self.plain(text):
            return sum(map(self.__getitem__, _WORDS.findall(text.lower())))
        return len(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """(start, tokens before it) of every word or token, and the end."""
        out, n = [], 0
        if self.plain(text):
            for m in _WORDS.finditer(text.lower()):
                out.append((m.start(), n))
                n += self[m[0]]
        else:
            for start, _ in self.library.encode(text, add_special_tokens=False).offsets:
                if not out or out[-1][0] != start:
                    out.append((start, n))
                n += 1
        return [*out, (len(text), n)]


_OPEN: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _OPEN:
        _OPEN[path] = Counter(path)
    return _OPEN[path]


def _stable(text: str, found: list[tuple[int, int]], base: int, low: int, high: int) -> tuple[list[int], list[int]]:
    """Document positions, and tokens before them, of the stable starts in (low, high)."""
    got = [(base + s, n) for s, n in found[:-1] if low < base + s < high and s > 0 and text[s - 1].isspace() and not text[s].isspace()]
    return [p for p, _ in got], [n for _, n in got]


def _huge(long: DataFrame, tokenizer: str, chunk: int, overlap: int, widen: int) -> DataFrame:
    """``_rid, n_tokens`` of the rows of ``long`` (``_rid, text``)."""
    done = None
    while True:

        def cut(batches, chunk=chunk, overlap=overlap):
            for b in batches:
                for rid, text in zip(b.column("_rid").to_pylist(), b.column("_text").to_pylist()):
                    last = max(0, -(-(len(text) - overlap) // chunk) - 1)
                    for k in range(last + 1):
                        piece = text[k * chunk:(k + 1) * chunk + overlap] if k < last else text[k * chunk:]
                        yield pa.RecordBatch.from_arrays([pa.array([rid], pa.int64()), pa.array([k], pa.int64()), pa.array([piece], pa.string())], ["_rid", "k", "piece"])

        def encode(batches, chunk=chunk, overlap=overlap):
            c = counter(tokenizer)
            for b in batches:
                rows = []
                for rid, k, text in zip(*(b.column(n).to_pylist() for n in ("_rid", "k", "piece"))):
                    found, base = c.offsets(text), k * chunk
                    left = _stable(text, found, base, base, base + overlap) if k else ([], [])
                    right = _stable(text, found, base, base + chunk, base + chunk + overlap)
                    rows.append((rid, k, found[-1][1], *left, *right))
                names = ["_rid", "k", "n", "left_at", "left_n", "right_at", "right_n"]
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)], names)

        pieces = long.mapInArrow(cut, "_rid long, k long, piece string").repartition(F.col("_rid"), F.col("k"))
        counts = written(pieces.mapInArrow(encode, "_rid long, k long, n long, left_at array<long>, left_n array<long>, "
                                                   "right_at array<long>, right_n array<long>"), "chunks")
        here = counts.select(F.col("_rid").alias("_r"), F.col("k").alias("_k"), F.col("left_at").alias("_left_at"), F.col("left_n").alias("_left_n"))
        splices = (counts.select("_rid", "k", "n", "right_at", "right_n")
                   .join(here, (F.col("_rid") == F.col("_r")) & (F.col("k") + 1 == F.col("_k")))
                   .withColumn("_at", F.array_min(F.array_intersect("right_at", "_left_at")))
                   .select("_rid", (F.col("n") - F.element_at("right_n", F.array_position("right_at", F.col("_at")).cast("int"))
                                    + F.element_at("_left_n", F.array_position("_left_at", F.col("_at")).cast("int"))).alias("twice")))
        total = (counts.select("_rid", "n", F.lit(0).alias("bad"))
                 .unionByName(splices.select("_rid", (-F.coalesce("twice", F.lit(0))).alias("n"), F.col("twice").isNull().cast("int").alias("bad")))
                 .groupBy("_rid").agg(F.sum("n").alias("n_tokens"), F.sum("bad").alias("_bad")))
        total = written(total, "spliced")
        good = total.where("_bad = 0").select("_rid", "n_tokens")
        done = good if done is None else done.unionByName(good)
        bad = total.where("_bad > 0").select(F.col("_rid").alias("_b"))
        if bad.isEmpty():
            return done
        long = written(long.join(bad, F.col("_rid") == F.col("_b"), "left_semi"), "widened")
        chunk, overlap = chunk * widen, overlap * widen


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                 limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP, widen: int = WIDEN) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("n_bytes"))
    huge = F.length("_text") > chunk_chars

    def run(batches):
        c = counter(tokenizer)
        for b in batches:
            n = [c.count(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    schema = rows.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_tokens")).schema
    short = rows.where(~huge).mapInArrow(run, schema)
    long = written(rows.where(huge).withColumn("_rid", F.monotonically_increasing_id()), "huge")
    counted = _huge(long.select("_rid", "_text"), tokenizer, chunk_chars, overlap, widen)
    out = short.unionByName(long.select("_rid", "doc_id", "n_bytes").join(counted, "_rid").drop("_rid"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
