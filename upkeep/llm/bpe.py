"""Byte-level BPE encoding and decoding with a compiled word lexicon.

The pre-tokens ("words") of all documents are counted; the most frequent ones,
at most ``max_words`` (a parameter, so the lexicon's size has a proven bound),
are merged once, in Spark, and compiled into a minimal acyclic transducer: words
share their prefixes and suffixes, every edge carries the number of words it
skips, and the sum along a word's path is the word's rank, which leads to its
ids. The file is published through the shared folder, fetched by each executor
and memory-mapped by its workers. A word that it lacks is merged exactly, so the
lexicon decides only the speed, never the ids.

Encoding follows the vocabulary file: special tokens inside a text are cut out
first, the rest is split by the byte-level pattern, each piece is merged by rank.
Texts of Latin letters take a character-class form of the same pattern.

Cases: a null text counts as empty and has no ids; a run of any length without a
break is merged with a heap; ids may be null or repeated, every row is encoded
by itself; an empty table gives an empty lexicon and no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import mmap
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import shared_path, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MAX_WORDS = 131_072
LONGEST = 48          # bytes of a lexicon word; longer ones are merged as they come
_CACHED = 400_000     # words a worker remembers at a time
_GROUP = 200_000      # characters of text that are split and looked up together
_BITS, _NO = 21, 1 << 40

# The byte-level pattern: fixed values.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SPACE = r"\p{White_Space}"
_ANY = regex.compile(PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", "[^" + _SPACE).replace(r"\s", _SPACE))
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-ɏ]")


def split_words(text: str) -> list[str]:
    return (_LATIN if text.isascii() or not _BEYOND.search(text) else _ANY).findall(text)


def byte_symbols() -> dict[str, int]:
    """The visible character that stands for each byte in the vocabulary file:
    printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge ranks of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.pieces = {i: bytes(symbols[c] for c in token) for token, i in vocab.items() if all(c in symbols for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces.update({i: content.encode() for content, i in self.special.items()})
        self.single = [vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])]
        self.pairs = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        known = sorted((a << _BITS | b, rank, new) for (a, b), (rank, new) in self.pairs.items())
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*known)) if known else (np.zeros(0, np.int64),) * 3

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge ranks of adjacent ids (``_NO`` without one) and the ids they make."""
        if not len(self.keys):
            return np.full(len(left), _NO), np.zeros(len(left), np.int64)
        key = left << _BITS | right
        at = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO), self.made[at]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word, all words at a time: every turn merges the lowest
        rank of each word that has one left, leftmost of equals."""
        out: list[bytes] = [b""] * len(words)
        long = [k for k, w in enumerate(words) if len(w) > 64]
        for k in long:
            out[k] = np.array(self.merge(words[k]), "<u4").tobytes()
        short = np.array([k for k, w in enumerate(words) if 0 < len(w) <= 64], np.int64)
        if not len(short):
            return out
        size = np.array([len(words[k]) for k in short.tolist()], np.int64)
        ids = np.array(self.single, np.int64)[np.frombuffer(b"".join(words[k] for k in short.tolist()), np.uint8)]
        last = np.zeros(len(ids), bool)
        last[size.cumsum() - 1] = True
        rank, made = np.full(len(ids), _NO), np.zeros(len(ids), np.int64)
        inner = np.flatnonzero(~last)
        rank[inner], made[inner] = self._ranks(ids[inner], ids[inner + 1])
        while len(short):
            ends = np.flatnonzero(last)
            starts = np.concatenate([[0], ends[:-1] + 1])
            least = np.minimum.reduceat(rank, starts)
            done = least == _NO
            if done.any():
                place = np.repeat(done, ends - starts + 1)
                packed, at = ids[place].astype("<u4").tobytes(), 0
                for k, n in zip(short[done].tolist(), (4 * (ends - starts + 1))[done].tolist()):
                    out[k] = packed[at:at + n]
                    at += n
                short, ids, last, rank, made = short[~done], ids[~place], last[~place], rank[~place], made[~place]
                continue
            hits = np.flatnonzero(rank == np.repeat(least, ends - starts + 1))
            word = ends.searchsorted(hits)
            at = hits[np.concatenate([[True], word[1:] != word[:-1]])]  # leftmost of each word
            ids[at] = made[at]
            last[at] = last[at + 1]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # one id less before each
            ids, last, rank, made = ids[stay], last[stay], rank[stay], made[stay]
            rank[at] = _NO
            before = at[at > 0] - 1
            fresh = np.concatenate([at[~last[at]], before[~last[before]]])
            rank[fresh], made[fresh] = self._ranks(ids[fresh], ids[fresh + 1])
        return out

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: always the lowest rank first, leftmost of equals."""
        ids, pairs = [self.single[b] for b in word], self.pairs
        if len(ids) > 64:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at = None, -1
            for k in range(len(ids) - 1):
                got = pairs.get((ids[k], ids[k + 1]))
                if got is not None and (best is None or got < best):
                    best, at = got, k
            if best is None:
                break
            ids[at:at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*got, k, k + 1) for k in range(n - 1) if (got := self.pairs.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, new, k, r = heapq.heappop(heap)
            if ids[k] is None or after[k] != r or r >= n or self.pairs.get((ids[k], ids[r])) != (rank, new):
                continue
            ids[k], ids[r] = new, None
            after[k] = after[r]
            if after[k] < n:
                before[after[k]] = k
            for a in (before[k], k):
                b = after[a] if a >= 0 else n
                if a >= 0 and b < n and (got := self.pairs.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (*got, a, b))
        return [i for i in ids if i is not None]


def compile_lexicon(words: list[tuple[bytes, bytes]]) -> bytes:
    """The transducer file of (word, packed ids) pairs, built incrementally from
    the sorted words: a finished node is replaced by an equal one if there is any."""
    words = sorted(words)
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, tuple, int]] = []  # final, ((label, node), ...), words below

    def freeze(final: bool, edges: list) -> int:
        key = (final, tuple(edges))
        if key not in register:
            register[key] = len(nodes)
            nodes.append((final, key[1], final + sum(nodes[t][2] for _, t in edges)))
        return register[key]

    path: list[list] = [[False, []]]  # open nodes along the last word
    last = b""
    for word, _ in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for k in range(len(last), same, -1):
            final, edges = path.pop()
            path[-1][1].append((last[k - 1], freeze(final, edges)))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        last = word
    for k in range(len(last), 0, -1):
        final, edges = path.pop()
        path[-1][1].append((last[k - 1], freeze(final, edges)))
    root = freeze(*path[0])
    first, labels, targets, skips = [0], bytearray(), [], []
    for final, edges, _ in nodes:
        skip = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(skip)
            skip += nodes[target][2]
        first.append(len(labels))
    finals = bytes(final for final, _, _ in nodes)
    ends = np.cumsum([0] + [len(ids) for _, ids in words], dtype=np.uint64).astype("<u4")
    # (node, label) of each edge as one ascending number, for lookups of many words at a time
    keys = np.repeat(np.arange(len(nodes)), np.diff(first)) << 8 | np.frombuffer(bytes(labels), np.uint8)
    parts = [keys.astype("<i8").tobytes(), np.array(first, "<u4").tobytes(), np.array(targets, "<u4").tobytes(), np.array(skips, "<u4").tobytes(),
             ends.tobytes(), bytes(labels), finals, b"".join(ids for _, ids in words)]
    head = np.array([root, *map(len, parts)], "<u8").tobytes()
    return head + b"".join(parts)


class Lexicon:
    """A memory-mapped transducer file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, "<u8", 9)
        at, view = 72, memoryview(self.map)
        self.root, cut = int(head[0]), []
        for n in head[1:].tolist():
            cut.append((at, at + n))
            at += n
        self.first, self.targets, self.skips, self.ends = (view[a:b].cast("I") for a, b in cut[1:5])
        self.labels, self.finals, self.ids = cut[5][0], cut[6][0], cut[7][0]
        # the same sections as arrays over the map
        self.arrays = [np.frombuffer(view[a:b], kind) for (a, b), kind in zip((cut[0], cut[2], cut[3], cut[4], cut[6]), ("<i8", "<u4", "<u4", "<u4", "u1"))]

    def get(self, word: bytes) -> bytes | None:
        node, rank, base, first = self.root, 0, self.labels, self.first
        for k in range(len(word)):
            e = self.map.find(word[k:k + 1], base + first[node], base + first[node + 1])
            if e < 0:
                return None
            rank += self.skips[e - base]
            node = self.targets[e - base]
        if not self.map[self.finals + node]:
            return None
        return self.map[self.ids + self.ends[rank]:self.ids + self.ends[rank + 1]]

    def get_many(self, words: list[bytes]) -> list[bytes | None]:
        """``get`` of each word, all words walked a byte at a time."""
        keys, targets, skips, ends, finals = self.arrays
        out: list[bytes | None] = [None] * len(words)
        if not words or not len(keys):
            return [self.get(w) for w in words]
        size = np.array([len(w) for w in words], np.int64)
        text, start = np.frombuffer(b"".join(words), np.uint8), size.cumsum() - size
        node, rank, live = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        for k in range(int(size.max())):
            step = live[size[live] > k]
            key = node[step] << 8 | text[start[step] + k]
            edge = np.minimum(keys.searchsorted(key), len(keys) - 1)
            found = keys[edge] == key
            node[step[~found]] = -1
            step, edge = step[found], edge[found]
            node[step], rank[step] = targets[edge], rank[step] + skips[edge]
            live = step
        hit = np.flatnonzero(node >= 0)
        hit = hit[finals[node[hit]] > 0]
        for k, a, b in zip(hit.tolist(), ends[rank[hit]].tolist(), ends[rank[hit] + 1].tolist()):
            out[k] = self.map[self.ids + a:self.ids + b]
        return out


class Codec(dict):
    """Texts to packed little-endian 32-bit ids and back, many at a time; remembers words."""

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        super().__init__()
        self.merges, self.lexicon = Merges(path), lexicon
        pieces = [self.merges.pieces.get(i, b"") for i in range(max(self.merges.pieces) + 1)]
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts, self.bytes = self.sizes.cumsum() - self.sizes, np.frombuffer(b"".join(pieces), np.uint8)
        self.specials = {s: np.array([i], "<u4").tobytes() for s, i in self.merges.special.items()}
        self.update(self.specials)  # an ordinary word is never one of them: they are cut out first

    def _words(self, text: str) -> list[str]:
        if any(s in text for s in self.specials):
            return [w for part in self.merges.cut.split(text) for w in ([part] if part in self.specials else split_words(part))]
        return split_words(text)

    def learn(self, words: set[str]) -> list[str]:
        """Remembers the words' ids, out of the lexicon or merged; returns the new words
        that are too long to be kept for later texts."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > _CACHED:
            self.clear()
            self.update(self.specials)
            new = [w for w in words if w not in self]
        raw = [w.encode() for w in new]
        brief = [k for k, r in enumerate(raw) if len(r) <= LONGEST] if self.lexicon else []
        got: list = [None] * len(new)
        if brief:
            for k, ids in zip(brief, self.lexicon.get_many([raw[k] for k in brief])):
                got[k] = ids
        rest = [k for k, ids in enumerate(got) if ids is None]
        for k, ids in zip(rest, self.merges.merge_many([raw[k] for k in rest])):
            got[k] = ids
        self.update(zip(new, got))
        return [w for w, r in zip(new, raw) if len(r) > 4 * LONGEST]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; ``_GROUP`` characters of text, or one longer text, at a time."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, lists = 0, []
            while at < len(texts) and (not lists or size + len(texts[at]) <= _GROUP):
                size += len(texts[at])
                lists.append(self._words(texts[at]))
                at += 1
            long = self.learn(set().union(*lists))
            out += [b"".join(map(self.__getitem__, words)) for words in lists]
            for w in long:
                del self[w]
        return out

    def decode_many(self, packed: list[bytes]) -> list[str]:
        """The text of each row of ids."""
        out: list[str] = []
        at = 0
        while at < len(packed):
            size, end = len(packed[at]), at + 1
            while end < len(packed) and size + len(packed[end]) <= 4 * _GROUP:
                size, end = size + len(packed[end]), end + 1
            ids = np.frombuffer(b"".join(packed[at:end]), "<u4")
            sizes = self.sizes[ids]
            ends = sizes.cumsum()
            text = self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
            ends = np.concatenate([[0], ends])
            cut = ends[np.cumsum([0] + [len(p) // 4 for p in packed[at:end]])].tolist()
            out += [text[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]
            at = end
        return out


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n`` over the whole texts of all documents (words of up to ``LONGEST`` bytes)."""

    def run(batches):
        def out(counts):
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        counts = Counter()
        for b in batches:
            for text in b.column("_text").to_pylist():
                counts.update(split_words(text))
                if len(counts) > 250_000:
                    yield from out(counts)
                    counts = Counter()
        yield from out(counts)

    return (docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(run, "word string, n long")
            .where(F.octet_length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n")))


def lexicon(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, max_words: int = MAX_WORDS) -> str:
    """Counts, compiles and publishes the lexicon; returns its file name."""
    spark = docs.sparkSession
    counts = written(word_counts(docs, text_col).where("n > 1").withColumn("_size", F.floor(F.log2("n") * 32)), "words")
    left, least = max_words, math.inf  # whole steps of frequency, as many as fit
    for r in sorted(counts.groupBy("_size").agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["_size"]):
        if r["c"] > left:
            break
        left, least = left - r["c"], r["_size"]

    def run(batches):
        merges = Merges(tokenizer)
        for b in batches:
            raw = [w.encode() for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(merges.merge_many(raw), pa.binary())], ["word", "ids"])

    chosen = counts.where(F.col("_size") >= (least if least < math.inf else 1 << 30)).select("word").repartition(8)
    got = chosen.mapInArrow(run, "word binary, ids binary").collect()  # at most max_words short rows
    data = compile_lexicon([(bytes(r["word"]), bytes(r["ids"])) for r in got])
    path = shared_path(spark, "lexicon") + ".bin"
    jvm, sc = spark._jvm, spark.sparkContext
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, False)
    stream.write(bytearray(data))
    stream.close()
    sc.addFile(path)
    return path.rsplit("/", 1)[1]


_OPEN: dict[tuple[str, str], Codec] = {}


def codec(tokenizer: str, name: str) -> Codec:
    """The worker's codec for a published lexicon (kept between tasks)."""
    if (tokenizer, name) not in _OPEN:
        _OPEN.clear()
        _OPEN[tokenizer, name] = Codec(tokenizer, Lexicon(SparkFiles.get(name)))
    return _OPEN[tokenizer, name]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def encode_documents(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids``: the ids packed as little-endian unsigned 32-bit integers."""
    rows = _rows(docs, id_col, text_col)

    def run(batches):
        c = codec(tokenizer, name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(c.encode_many(b.column("_text").to_pylist()), pa.binary())], ["doc_id", "ids"])

    return rows.mapInArrow(run, rows.select("doc_id", F.lit(b"").alias("ids")).schema)


def decode_documents(encoded: DataFrame, name: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, text`` from packed ids, special tokens written out."""

    def run(batches):
        c = codec(tokenizer, name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(c.decode_many([i or b"" for i in b.column("ids").to_pylist()]), pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, encoded.select("doc_id", F.lit("").alias("text")).schema)


def round_trip(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded and decoded again
    in one pass, so the ids need not travel between the two."""
    rows = _rows(docs, id_col, text_col)

    def run(batches):
        c = codec(tokenizer, name)
        for b in batches:
            packed = c.encode_many(b.column("_text").to_pylist())
            n, ids_sha = [len(ids) // 4 for ids in packed], [hashlib.sha256(ids).hexdigest() for ids in packed]
            text_sha = [hashlib.sha256(text.encode()).hexdigest() for text in c.decode_many(packed)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"),
                                            F.lit("").alias("decoded_sha256")).schema)
