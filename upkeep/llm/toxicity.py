"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over the
word stems it holds; the document's score is their noisy-or, 1 - prod(1 - p).
Only document labels are used for training: the likelihood of the noisy-or is
maximised, so the weights settle on the sentences that explain a toxic label,
and the sentence scores then locate the offending sentences.

Features are lower-cased words and their first four to six letters, so one
stem covers its inflections. Candidates are counted over the training texts in
Spark; those that stand out most among toxic documents (``MAX_FEATURES``) are
kept. Training rows are labelled documents, at most ``train_rows`` (a documented
bound; the rows with the smallest hash of their id, a random but repeatable
choice), one row each: of documents that share a picked id, the text that sorts
last. Scoring covers every whole text.

Cases: null texts count as empty and get the score of an empty document; rows
with null or other than 0/1 labels are not learned from; of repeated labels the
largest counts; without any toxic training row every score is 0; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import written

TRAIN_ROWS = 20_000
MAX_FEATURES = 1024
MIN_TOXIC = 6        # toxic training documents a feature must occur in
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def held_out(id_col):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def _features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


class Lookup(dict):
    """word -> indices of its features, worked out once per word and bounded."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        got = tuple(self.index[f] for f in _features(word) if f in self.index)
        self[word] = got
        return got


def bag(text: str, lookup: Lookup) -> tuple[int, list[tuple[int, int, tuple[int, ...]]]]:
    """Number of sentences, and (start, end, features) of those with any."""
    low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower()[0] for c in text)
    if not any(map(lookup.__getitem__, _WORD.findall(low))):
        return len(_SENTENCE.findall(low)), []
    found, n = [], 0
    for m in _SENTENCE.finditer(low):
        n += 1
        got = sorted({f for w in _WORD.findall(m[0]) for f in lookup[w]})
        if got:
            found.append((m.start(), m.end(), tuple(got)))
    return n, found


def feature_counts(train: DataFrame) -> DataFrame:
    """``feature, toxic, clean``: training documents of each kind that hold it."""

    def run(batches):
        for b in batches:
            counts = (Counter(), Counter())
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                counts[y].update({f for w in set(_WORD.findall(text.lower())) for f in _features(w)})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([counts[1][w] for w in names], pa.int64()),
                 pa.array([counts[0][w] for w in names], pa.int64())], ["feature", "toxic", "clean"])

    return (train.select("text", "y").mapInArrow(run, "feature string, toxic long, clean long")
            .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def fit(rows: list[tuple[int, int, list[tuple[int, ...]]]], n_features: int, steps: int = 400, rate: float = 0.2,
        l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient ascent (Adam) on the noisy-or likelihood.
    rows: (label, sentences without features, features of the other sentences)."""
    y = np.array([r[0] for r in rows], dtype=float)
    plain = np.array([r[1] for r in rows], dtype=float)
    doc = np.array([d for d, r in enumerate(rows) for _ in r[2]], dtype=np.int64)
    flat = np.array([f for r in rows for s in r[2] for f in s], dtype=np.int64)
    sent = np.repeat(np.arange(len(doc)), [len(s) for r in rows for s in r[2]]) if len(doc) else flat
    w, b = np.zeros(n_features), -6.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(sent, w[flat], minlength=len(doc))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-b))
        log_clean = plain * math.log1p(-p0) + np.bincount(doc, -np.logaddexp(0, z), minlength=len(y))
        clean = np.exp(np.minimum(log_clean, -1e-9))
        # d log-likelihood / d log_clean: toxic documents -clean / (1 - clean), clean ones 1
        g = np.where(y > 0, -clean / (1 - clean), 1.0)
        gz = g[doc] * -p
        grad = np.append(np.bincount(flat, gz[sent], minlength=n_features) / len(y) - l2 * w,
                         (gz.sum() - (g * plain).sum() * p0) / len(y))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w + step[:-1], min(b + step[-1], -3.0)
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          train_rows: int = TRAIN_ROWS) -> dict:
    """The model: features, weights, bias. Only rows outside the held-out third
    are read as labels."""
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).where(~held_out(id_col))
             .groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("y")))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    data = (docs.join(F.broadcast(picked), F.col(id_col) == F.col("_id"))  # at most train_rows small rows
            .groupBy("_id", "y").agg(F.max(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).select("text", "y"))
    data = written(data, "toxic-train")
    total = {r["y"]: r["n"] for r in data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad:
        return {"features": [], "weights": np.zeros(0), "bias": -50.0}
    rate = F.col("toxic") / float(bad)
    base = (F.col("clean") + 0.5) / float(good + 1)
    best = (feature_counts(data).where((F.col("toxic") >= MIN_TOXIC) & (rate > 4 * base))
            .withColumn("_z", (rate - base) / F.sqrt(rate / float(bad) + base / float(good + 1)))
            .orderBy(F.desc("_z"), "feature").limit(MAX_FEATURES))
    features = [r["feature"] for r in best.select("feature").collect()]
    index = {f: i for i, f in enumerate(features)}

    def bags(batches):
        lookup = Lookup(index)
        for b in batches:
            got = [bag(t, lookup) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), pa.array([n - len(s) for n, s in got], pa.int64()),
                 pa.array([[list(f) for _, _, f in s] for _, s in got], pa.list_(pa.list_(pa.int64())))], ["y", "plain", "found"])

    compact = data.mapInArrow(bags, "y int, plain long, found array<array<long>>").collect()
    w, b = fit([(r["y"], r["plain"], [tuple(s) for s in r["found"]]) for r in compact], len(features))
    return {"features": features, "weights": w, "bias": b}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted, offending`` (start, end and score of
    every sentence scored 0.5 or more, in code points of the text)."""
    index = {f: i for i, f in enumerate(model["features"])}
    w, bias = model["weights"].tolist(), float(model["bias"])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *([F.struct(*carry).alias("_carry")] if carry else []))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    plain = math.log1p(-1 / (1 + math.exp(-bias)))

    def run(batches):
        lookup = Lookup(index)
        for b in batches:
            scores, where = [], []
            for text in b.column("_text").to_pylist():
                n, found = bag(text, lookup)
                log_clean, bad = plain * (n - len(found)), []
                for start, end, got in found:
                    z = bias + sum(w[f] for f in got)
                    p = 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))
                    log_clean += math.log1p(-min(p, 1 - 1e-12))
                    if p >= 0.5:
                        bad.append({"start": start, "end": end, "score": p})
                scores.append(-math.expm1(log_clean))
                where.append(bad)
            arrays = [b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()),
                      pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(where, kind)]
            names = ["doc_id", "held_out", "score", "predicted", "offending"]
            if carry:
                arrays.append(b.column("_carry"))
                names.append("_carry")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"),
                         F.lit(None).cast("array<struct<start:long,end:long,score:double>>").alias("offending"),
                         *(["_carry"] if carry else [])).schema
    return rows.mapInArrow(run, schema)
