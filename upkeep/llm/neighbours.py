"""Nearest neighbours by collision-counting hashing.

Largest inner product is turned into smallest angle: the vectors of a block are
split into ranges of similar length, and every vector gets one more component so
that all have the length of the longest of their range; queries get a zero. Each
of ``projections`` random lines orders the vectors of a range in a sorted array.
A query's window on each line is centred on its own projection and expanded by
virtual rehashing, radius by radius, from the radius that the best of a few
vectors asks for; a vector inside the windows of at least
``threshold`` lines has collided often enough and is verified with its inner
product in double precision.

Ranges are searched from the longest vectors down. The ``k``-th score found so
far, over the longest vector of a range, is a bound on the angle, and so on the
distance, that a vector of the range needs to score better. Such a vector's
distance from the query on a line is normal with that deviation, so at every
radius the chance that it still lacks collisions is known: expansion ends when
that chance is at most ``miss`` (or every vector has been seen), whatever share
of the vectors has been verified by then. A range whose longest vector can't
reach the ``k``-th score is left out; ranges of a few vectors are verified whole.

Matrix products may round equal vectors differently, so they only pick the
candidates, with a margin for their rounding: the scores that are returned and
ranked are sums of products in the order of the components, the same for equal
vectors wherever they stand.

The vectors are dealt into blocks of bounded size, the queries into sets of
bounded size; every set meets every block in a task of its own, and the best
``k`` of each are merged per query. A set holds as many queries as ``SET_NUMBERS``
components allow, fewer only where there would be less tasks than cores, so rows
are copied once per tens of thousands of queries. All rows are indexed.

Cases: vectors that are null, empty, zero or hold null or non-finite components
take no part; vectors of another dimension than the query's aren't compared; a
candidate with the query's own id is the query itself; repeated ids are
candidates of their own, and each row of a repeated query id is a query of its
own with up to ``k`` neighbours (ranks start over); a null id is a candidate (last among ties), never a
query; fewer candidates than ``k``: all of them; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upkeep.llm.common import written

PROJECTIONS = 64
THRESHOLD = 0.68     # share of the lines on which a vector must collide
WIDTH = 1.0          # half width of a window at radius 1, in units of a line
SAMPLE = 256         # vectors whose best score sets the first radius
LEAST_RADIUS = 0.05  # windows of no width would never grow
RATIO = 1.12         # growth of the radius
MISS = 0.02          # chance that a vector with a better score is still unseen when expansion ends
SPREAD = 0.8         # least length in a range, as a share of its longest
BLOCK_ROWS = 8192
SET_NUMBERS = 4 << 20  # components of a set of queries
SEED = 7
NO_ID = -(1 << 62)     # stands for a null id within a block


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of the components."""
    out = np.zeros(len(vectors))
    for d in range(len(query)):
        out += vectors[:, d] * query[d]
    return out


def reach_for(projections: int, threshold: int, miss: float) -> float:
    """Radius, in units of a vector's distance from the query, at which it lacks
    ``threshold`` collisions on ``projections`` lines with a chance of ``miss``."""
    low, high = 0.0, 40.0
    for _ in range(60):
        z = (low + high) / 2
        p = math.erf(z / math.sqrt(2))
        lacking = sum(math.comb(projections, i) * p ** i * (1 - p) ** (projections - i) for i in range(threshold))
        low, high = (z, high) if lacking > miss else (low, z)
    return high


class Range:
    """Sorted projection arrays of the vectors of a block that have similar lengths."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, lines: np.ndarray):
        self.ids, self.vectors, self.longest, self.lines = ids, vectors, lengths.max(), lines
        rest = np.sqrt(np.maximum(self.longest ** 2 - lengths ** 2, 0))
        at = (np.column_stack([vectors, rest]) / self.longest) @ lines.T
        self.order = np.argsort(at, axis=0, kind="stable").T.ravel()
        # all sorted arrays in one, each moved clear of the last, so one search serves all lines
        self.apart = 4 * (1 + np.abs(at).max()) * np.arange(len(lines))
        self.sorted = (np.sort(at, axis=0).T + self.apart[:, None]).ravel()
        self.sample = np.linspace(0, len(ids) - 1, min(len(ids), SAMPLE)).astype(np.int64)

    def nearest(self, own: int, query: np.ndarray, length: float, k: int, threshold: int, reach_z: float,
                best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the verified vectors; ``best``: the best scores of other ranges, ``k`` at most."""
        n, order, lines = len(self.ids), self.order, len(self.lines)
        centre = self.lines[:, :-1] @ (query / length)
        edge = np.abs(self.apart[1] if lines > 1 else np.inf) / 2

        def enough(score: float) -> float:
            """The radius that a vector with a better score needs at most."""
            return reach_z * math.sqrt(2 - 2 * max(-1.0, min(1.0, score / (self.longest * length)))) / WIDTH

        # a few vectors tell about how far the best ones are; from there radius by radius
        radius = max(LEAST_RADIUS, enough((self.vectors[self.sample] @ query).max()))
        seen = np.zeros(n, dtype=bool)
        rows, scores = np.empty(0, dtype=np.int64), np.empty(0)
        while True:
            a = self.sorted.searchsorted(np.maximum(centre - WIDTH * radius, -edge) + self.apart).tolist()
            b = self.sorted.searchsorted(np.minimum(centre + WIDTH * radius, edge) + self.apart, side="right").tolist()
            # count the smaller part: the collisions, or the lines without one
            if 2 * (sum(b) - sum(a)) < lines * n:
                hits = np.bincount(np.concatenate([order[x:y] for x, y in zip(a, b)]), minlength=n)
            else:
                outside = [order[x:y] for l, (x, y) in enumerate(zip(a, b)) for x, y in ((l * n, x), (y, l * n + n)) if x < y]
                hits = lines - np.bincount(np.concatenate(outside), minlength=n) if outside else np.full(n, lines)
            new = np.flatnonzero((hits >= threshold) & ~seen)
            seen[new] = True
            new = new[self.ids[new] != own]
            got = self.vectors[new] @ query
            rows, scores = np.append(rows, new), np.append(scores, got)
            best = np.append(best, got)
            best = np.partition(best, -k)[-k:] if len(best) > k else best
            if seen.all():
                break
            if len(best) == k:
                if radius >= (last := enough(best.min())):
                    break
                radius = min(radius * RATIO, last)
            else:
                radius *= RATIO
        return rows, scores


class Block:
    """Ranges of one block of vectors, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.last = np.where(ids == NO_ID, np.iinfo(np.int64).max, ids)  # order among ties
        lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        by_length = np.argsort(-lengths, kind="stable")
        lines = np.random.default_rng(SEED).standard_normal((projections, vectors.shape[1] + 1))
        self.ranges: list[tuple[np.ndarray, float, Range | None]] = []  # rows, longest, arrays unless verified whole
        falling, at = -lengths[by_length], 0
        while at < len(falling):
            end = max(int(falling.searchsorted(falling[at] * SPREAD, side="right")), min(at + 4 * k, len(falling)))
            rows = by_length[at:end]
            self.ranges.append((rows, -falling[at], Range(ids[rows], vectors[rows], lengths[rows], lines) if end - at > 4 * k and falling[at] else None))
            at = end

    def nearest(self, own: int, query: np.ndarray, threshold: int, reach_z: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the best ``k`` verified vectors, ties to the smaller id."""
        k, length = self.k, math.sqrt(query @ query)
        # twice what two ways of summing can differ by
        margin = 4 * len(query) * 2.3e-16 * length * (self.ranges[0][1] if self.ranges else 0.0)
        rows, scores = np.empty(0, dtype=np.int64), np.empty(0)
        for part, longest, arrays in self.ranges:
            if len(scores) >= k and scores.min() > longest * length * (1 + 1e-9):
                break
            if arrays is None or not length:  # few vectors, or lengths too small for a double
                new = part[self.ids[part] != own]
                got = self.vectors[new] @ query
            else:
                new, got = arrays.nearest(own, query, length, k, threshold, reach_z, scores if len(scores) <= k else np.partition(scores, -k)[-k:])
                new = part[new]
            rows, scores = np.append(rows, new), np.append(scores, got)
            if len(rows) > k:
                kept = scores >= np.partition(scores, -k)[-k] - margin
                rows, scores = rows[kept], scores[kept]
        scores = exact_scores(self.vectors[rows], query)
        first = np.lexsort((self.last[rows], -scores))[:k]
        return rows[first], scores[first]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    out = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return out.where(~F.coalesce(bad, F.lit(True))).where(F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            projections: int = PROJECTIONS, threshold: float = THRESHOLD, miss: float = MISS,
            block_rows: int = BLOCK_ROWS, query_rows: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``; ``is_query``: a function of the id column."""
    rows = written(usable(vectors, id_col, vec_col).withColumn("_rid", F.monotonically_increasing_id()), "vectors")
    asked = rows.where(is_query(F.col("id")))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(is_query(F.col("id")).cast("long")).alias("q"), F.max(F.size("v")).alias("dim")).first()
    blocks = max(1, math.ceil((facts["n"] or 0) / block_rows))
    cores = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    sets = max(1, math.ceil((facts["q"] or 0) / (query_rows or max(1, SET_NUMBERS // (facts["dim"] or 1)))), min(math.ceil((facts["q"] or 0) / 256), math.ceil(cores / blocks)))
    least = max(1, round(threshold * projections))
    reach_z = reach_for(projections, least, miss)

    def spread(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n):
        return F.pmod(F.xxhash64("_rid"), F.lit(n)).cast("int")

    # every set of queries meets every block: both sides bounded, one task each
    data = rows.select(F.size("v").alias("dim"), dealt(blocks).alias("block"), spread(sets).alias("set"), F.lit(False).alias("asks"), "_rid", "id", "v")
    queries = asked.select(F.size("v").alias("dim"), spread(blocks).alias("block"), dealt(sets).alias("set"), F.lit(True).alias("asks"), "_rid", "id", "v")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        known, asks = part[~part["asks"]], part[part["asks"]]
        asked_by, asking, found_ids, found_scores = [], [], [], []
        if len(known) and len(asks):
            ids = known["id"].astype("Int64")
            own = ids.fillna(NO_ID).to_numpy(dtype=np.int64)
            block = Block(own, np.array(known["v"].tolist(), dtype=float), projections, k)
            names = ids.to_numpy(dtype=object)
            for rid, q, v in zip(asks["_rid"], asks["id"], asks["v"]):
                got, scores = block.nearest(int(q), np.array(v, dtype=float), least, reach_z)
                asking.append(np.full(len(got), int(rid)))
                asked_by.append(np.full(len(got), int(q)))
                found_ids.append(names[got])
                found_scores.append(scores)
        if not asked_by:
            return pd.DataFrame({"_rid": [], "query_id": [], "vec_id": [], "score": []}).astype({"_rid": "int64", "query_id": "int64", "vec_id": "Int64", "score": float})
        return pd.DataFrame({"_rid": np.concatenate(asking), "query_id": np.concatenate(asked_by), "vec_id": pd.array(np.concatenate(found_ids), dtype="Int64"),
                             "score": np.concatenate(found_scores)})

    found = (data.unionByName(queries).groupBy("dim", "block", "set")
             .applyInPandas(search, "_rid long, query_id long, vec_id long, score double"))
    order = Window.partitionBy("_rid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
