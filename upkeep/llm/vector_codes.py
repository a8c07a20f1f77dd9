"""Vector code compression with anchors-hierarchy metric trees.

Vectors become integers, floor(4096 * x), and are cut into ``parts`` equal
consecutive parts; each part position has a codebook of up to ``entries``
entries, refined in rounds (assign every part to its nearest entry, replace each
entry by the floored mean of its parts) and used once more for the codes.

The assignment runs on metric trees. Rows are gathered in blocks of at most
``block_rows`` vectors, and every block gets a tree per part position, built once
from the middle out: anchors take over the points nearer to them than to any
older anchor, about the square root of them all; the anchors' balls are joined
upwards, always the pair with the smallest common ball, and an anchor with many
points is split the same way below. A ball caches the count, the sum, the floored
centroid of its points and the radius around that centroid.

A round walks the trees from their roots. A ball inherits the list of entries
that can be nearest to a point of its parent; an entry leaves the list where
another is nearer for the whole ball, and when one is left, the ball's cached sum
and count are its share of that entry. Only leaves with more than one entry left
look at points. The comparison is exact in integers but for the radius term, and
that is widened, so lists never lose the nearest entry; ties go to the smaller
index. What a round sends to the driver are sums per entry, its closure holds
the codebook: both are bounded by parts x entries x components. The trees are a
written table, so a lost executor costs a re-read.

Cases: null vectors and those with null or non-finite components are dropped;
of the others, lengths that are no positive multiple of ``parts`` or differ from
that of the smallest remaining vec_id cannot be cut alike and are dropped too;
a null vec_id comes after all others, rows with equal vec_id are ordered by
their components and all stay; fewer than ``entries`` rows make a shorter
codebook; equal entries leave the later one unused; null labels form one group;
an empty table gives no rows; components so large that a distance could exceed a
64-bit integer raise ValueError; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upkeep.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK_ROWS = 4096
BLOCK_NUMBERS = 4 << 20  # components of a block at most; long vectors make shorter blocks
LEAF = 48  # points of a ball that is not split further


# ---- trees ------------------------------------------------------------------------
def _anchors(points: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Owner of each point and the anchors (row numbers), about sqrt(n) of them."""
    n = len(points)
    anchors, owner = [0], np.zeros(n, np.int64)
    far = ((points - points[0]) ** 2).sum(1)
    while len(anchors) < max(2, round(n ** 0.5)):
        new = int(far.argmax())
        if far[new] == 0:
            break
        # only points farther from their anchor than half way to the new one can change
        between = ((points[anchors] - points[new]) ** 2).sum(1)
        open_ = np.flatnonzero(4.0 * far >= between[owner] * (1 - 1e-9))
        to_new = ((points[open_] - points[new]) ** 2).sum(1)
        taken = to_new < far[open_]
        owner[open_[taken]], far[open_[taken]] = len(anchors), to_new[taken]
        anchors.append(new)
    return owner, anchors


def _join(points: np.ndarray, groups: list[np.ndarray], anchors: list[int]) -> list:
    """Binary tree over the anchors: the two balls with the smallest common ball are
    joined until one is left. Leaves are positions in ``groups``."""
    centre = points[anchors].astype(float)
    radius = np.array([np.sqrt(((points[g] - points[a]) ** 2).sum(1).max()) for g, a in zip(groups, anchors)])
    size = np.array([len(g) for g in groups], float)
    tree: list = list(range(len(groups)))

    def common(k: int) -> np.ndarray:
        apart = np.sqrt(((centre - centre[k]) ** 2).sum(1))
        out = np.maximum((apart + radius + radius[k]) / 2, np.maximum(radius, radius[k]))
        out[k] = np.inf
        return out

    cost = np.array([common(k) for k in range(len(groups))])
    for _ in range(len(groups) - 1):
        a, b = divmod(int(cost.argmin()), len(groups))
        tree[a], tree[b], radius[a] = (tree[a], tree[b]), None, cost[a, b]
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        gone = np.isinf(cost[a]) & (np.arange(len(groups)) != a)
        cost[b], cost[:, b] = np.inf, np.inf
        fresh = common(a)
        fresh[gone] = np.inf
        fresh[b] = np.inf
        cost[a], cost[:, a] = fresh, fresh
    return next(t for t in tree if t is not None)


class Balls:
    """The metric tree of one part position of a block. Points lie in tree order
    (``order`` gives their rows), so every ball is a range of them."""

    def __init__(self, points: np.ndarray):
        self.order: list[int] = []
        nodes: list[list[int]] = []  # start, end, left, right (-1: leaf)

        def grow(rows: np.ndarray) -> int:
            if len(rows) > LEAF:
                owner, anchors = _anchors(points[rows])
                if len(anchors) > 1:
                    groups = [rows[owner == k] for k in range(len(anchors))]
                    return place(_join(points, groups, [int(rows[a]) for a in anchors]), groups)
            nodes.append([len(self.order), len(self.order) + len(rows), -1, -1])
            self.order.extend(rows.tolist())
            return len(nodes) - 1

        def place(tree, groups: list[np.ndarray]) -> int:
            # without recursion along the joined tree, which may be as deep as it has anchors
            done, todo = [], [(tree, False)]
            while todo:
                t, joined = todo.pop()
                if not isinstance(t, tuple):
                    done.append(grow(groups[t]))
                elif joined:
                    right, left = done.pop(), done.pop()
                    nodes.append([nodes[left][0], nodes[right][1], left, right])
                    done.append(len(nodes) - 1)
                else:
                    todo += [(t, True), (t[1], False), (t[0], False)]
            return done[0]

        if len(points):
            grow(np.arange(len(points)))
        self.order = np.array(self.order, np.int64)
        self.points = points[self.order]
        self.nodes = np.array(nodes, np.int64).reshape(-1, 4)
        start, end = self.nodes[:, 0], self.nodes[:, 1]
        run = np.vstack([np.zeros((1, points.shape[1]), np.int64), self.points.cumsum(0)])
        self.sums = run[end] - run[start]
        self.counts = end - start
        self.centres = self.sums // np.maximum(self.counts, 1)[:, None]
        far = [((self.points[a:b] - c) ** 2).sum(1).max() for (a, b, _, _), c in zip(self.nodes.tolist(), self.centres)]
        self.radii = np.sqrt(np.array(far, float)) * (1 + 1e-12)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.points), self.points.shape[1], len(self.nodes)], np.int64)
        arrays = (head, self.order, self.points, self.nodes, self.sums, self.centres, self.radii.view(np.int64))
        return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)

    @classmethod
    def from_bytes(cls, data: bytes) -> Balls:
        flat, at = np.frombuffer(data, np.int64), 3
        n, w, m = flat[:3].tolist()
        out = cls.__new__(cls)
        for name, shape in (("order", (n,)), ("points", (n, w)), ("nodes", (m, 4)), ("sums", (m, w)), ("centres", (m, w)), ("radii", (m,))):
            size = int(np.prod(shape))
            setattr(out, name, flat[at:at + size].reshape(shape))
            at += size
        out.radii = out.radii.view(float)
        out.counts = out.nodes[:, 1] - out.nodes[:, 0]
        return out

    def walk(self, book: np.ndarray):
        """Yields (range start, range end, entry, ball) for wholly owned balls and
        (rows in tree order, their entries) for the points of leaves that several
        entries share. ``book``: (entries, components)."""
        if not len(self.nodes):
            return
        k = len(book)
        apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
        gap = np.sqrt(apart.astype(float))
        level, lists = np.array([len(self.nodes) - 1]), np.ones((1, k), bool)
        while len(level):
            centre, radius = self.centres[level], self.radii[level]
            dist = ((centre[:, None, :] - book[None, :, :]) ** 2).sum(2)
            first = np.where(lists, dist, np.iinfo(np.int64).max).argmin(1)  # nearest to the centre, smallest index
            lead = dist - dist[np.arange(len(level)), first][:, None]
            reach = 2 * radius[:, None] * gap[first] * (1 + 1e-9)
            same = (apart[first] == 0) | (radius == 0)[:, None]  # nearest for all points, or equal throughout
            out = (lead > reach) & ~same | same & ((lead > 0) | (np.arange(k)[None, :] > first[:, None]))
            lists = lists & ~out
            alone = lists.sum(1) == 1
            for node, entry in zip(level[alone].tolist(), lists[alone].argmax(1).tolist()):
                yield int(self.nodes[node, 0]), int(self.nodes[node, 1]), entry, node
            level, lists = level[~alone], lists[~alone]
            leaf = self.nodes[level, 2] < 0
            if leaf.any():
                ends = self.nodes[level[leaf], 1]
                size = self.counts[level[leaf]]
                rows = np.repeat(ends - size.cumsum(), size) + np.arange(int(size.sum()))
                open_ = np.repeat(lists[leaf], size, axis=0)
                near = np.full(open_.shape, np.iinfo(np.int64).max)
                for entry in range(k):  # one entry at a time, so memory does not grow with the codebook
                    some = open_[:, entry]
                    near[some, entry] = ((self.points[rows[some]] - book[entry]) ** 2).sum(1)
                yield rows, near.argmin(1)
            inner, kept = level[~leaf], lists[~leaf]
            level, lists = self.nodes[inner][:, 2:].ravel(), np.repeat(kept, 2, axis=0)

    def shares(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the points of each entry."""
        sums, counts = np.zeros_like(book), np.zeros(len(book), np.int64)
        for got in self.walk(book):
            if len(got) == 4:
                sums[got[2]] += self.sums[got[3]]
                counts[got[2]] += got[1] - got[0]
            else:
                np.add.at(sums, got[1], self.points[got[0]])
                counts += np.bincount(got[1], minlength=len(book))
        return sums, counts

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row of the block."""
        entry = np.zeros(len(self.points), np.int64)
        for got in self.walk(book):
            if len(got) == 4:
                entry[got[0]:got[1]] = got[2]
            else:
                entry[got[0]] = got[1]
        dist = ((self.points - book[entry]) ** 2).sum(1)
        back = np.empty_like(self.order)
        back[self.order] = np.arange(len(self.order))
        return entry[back], dist[back]


# ---- Spark --------------------------------------------------------------------------
@dataclass
class Codebooks:
    """``books``: integers (part, entry, component)."""

    books: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """``vec_id, label, v`` of the rows that take part, and the common length (0: no rows)."""
    v = F.col(vec_col)
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(v, lambda x: x.cast("double") * scale).alias("_x")
    kept = vectors.where(v.isNotNull() & whole & (F.size(v) > 0) & (F.size(v) % parts == 0)) \
                  .select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), scaled)
    first = F.min_by(F.size("_x"), F.struct(F.col("vec_id").isNull(), F.col("vec_id"), F.col("_x")))
    seen = kept.agg(first.alias("length"), F.max(F.array_max(F.transform("_x", F.abs))).alias("most")).first()
    length = seen["length"] or 0
    if length and not length * (2.0 * seen["most"] + 2) ** 2 < 2.0 ** 62:
        raise ValueError(f"components up to {seen['most'] / scale:g} make distances that 64 bits do not hold")
    return kept.where(F.size("_x") == length).select("vec_id", "label", F.transform("_x", lambda x: F.floor(x)).alias("v")), length


def first_books(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The codebooks before the first round: the parts of the smallest vec_ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return Codebooks(np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2))


def block_trees(rows: DataFrame, length: int, parts: int = PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a block: the ids and labels of its rows and a tree for each part position."""
    most = max(64, min(block_rows, BLOCK_NUMBERS // length))
    kinds = dict((f.name, f.dataType) for f in rows.schema.fields)
    schema = T.StructType([T.StructField("vec_id", T.ArrayType(kinds["vec_id"])), T.StructField("label", T.ArrayType(kinds["label"])),
                           T.StructField("trees", T.ArrayType(T.BinaryType()))])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, most):
                block = b.slice(at, most)
                points = block.column("v").flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, parts, length // parts)
                trees = [Balls(np.ascontiguousarray(points[:, k])).to_bytes() for k in range(parts)]
                lists = [pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), pa.concat_arrays([block.column(c)])) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.binary()))], ["vec_id", "label", "trees"])

    return written(rows.mapInArrow(run, schema), "ball-trees")


def refine(trees: DataFrame, before: Codebooks) -> Codebooks:
    """One round: every entry becomes the floored mean of its parts."""
    books = before.books
    parts, entries, width = books.shape

    def run(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for block in b.column("trees").to_pylist():
                for k, tree in enumerate(block):
                    s, n = Balls.from_bytes(tree).shares(books[k])
                    sums[k] += s
                    counts[k] += n
        part, entry, place = (x.ravel() for x in np.indices(books.shape))
        n = np.repeat(counts.ravel(), width)
        used = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (part, entry, place, sums.ravel(), n)], ["part", "entry", "place", "s", "n"])

    got = trees.select("trees").mapInArrow(run, "part long, entry long, place long, s long, n long") \
               .groupBy("part", "entry", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    after = books.copy()
    for r in got:
        after[r["part"], r["entry"], r["place"]] = int(r["s"]) // r["n"]
    return Codebooks(after)


def encode(trees: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error`` of every row."""
    kinds = {f.name: f.dataType.elementType for f in trees.schema.fields}
    schema = T.StructType([T.StructField("vec_id", kinds["vec_id"]), T.StructField("label", kinds["label"]),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    book = books.books

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                block = b.slice(at, 1)
                found = [Balls.from_bytes(t).assign(book[k]) for k, t in enumerate(block.column("trees")[0].as_py())]
                codes = np.stack([entry for entry, _ in found], 1).astype(np.uint8)
                error = np.sum([dist for _, dist in found], axis=0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([block.column("vec_id").flatten(), block.column("label").flatten(),
                                                  pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())],
                                                 ["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``vec_id, vector``: the entries that a code names, put together."""
    per_entry = F.array(*[F.array(*[F.array(*[F.lit(x / scale) for x in entry]) for entry in part]) for part in books.books.tolist()])
    picked = [F.get(F.get(per_entry, F.lit(k)), F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int")) for k in range(len(books.books))]
    return codes.select("vec_id", F.concat(*picked).alias("vector"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row that takes part."""
    rows, length = integer_vectors(vectors, id_col, vec_col, label_col, parts, scale)
    if not length:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
                           F.lit("").alias("codebooks_sha256"))
    books = first_books(rows, length, parts, entries)
    trees = block_trees(rows, length, parts)
    for _ in range(rounds):
        books = refine(trees, books)
    coded = written(encode(trees, books), "vector-codes")
    by_label = written(coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_l")), "left") \
                .select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
