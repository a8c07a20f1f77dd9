"""Vector codes against a plain k-means of Python integers, and the trees by themselves."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest

from upkeep.llm import vector_codes as vc
from upkeep.llm.queries import ORACLE, op12_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label) as stored."""
    kept = [(i, [math.floor(4096 * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[v[k * w:(k + 1) * w] for k in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][k] for r in first] for k in range(parts)]

    def nearest(p, book):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            own = {}
            for r in cut:
                own.setdefault(nearest(r[k], books[k])[1], []).append(r[k])
            books[k] = [[sum(x) // len(own[e]) for x in zip(*own[e])] if e in own else c for e, c in enumerate(books[k])]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [[nearest(r[k], books[k]) for k in range(parts)] for r in cut]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, label), e in zip(kept, errors):
        total[label] = total.get(label, 0) + e
    return [(i, "".join(f"{e:02x}" for _, e in f), err, total[label], sha) for (i, _, label), f, err in zip(kept, found, errors)]


def rounded(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]


def check(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = sorted(map(str, map(tuple, vc.compress(df).collect())))
    assert got == sorted(map(str, brute(rounded(rows))))
    return got


def some(n, dims=16, seed=1, spread=1.0):
    rnd = random.Random(seed)
    return [(k, [rnd.gauss(0, spread) for _ in range(dims)], rnd.choice([0, 1, None])) for k in range(n)]


def test_against_plain_rounds(spark):
    check(spark, some(700))


def test_hot_vector_ties_nulls_and_repeated_rows(spark):
    rows = some(150, seed=2)
    rows += [(1000 + k, [0.25] * 16, 1) for k in range(90)]            # one very common vector
    rows += [(5, [round(x * 4) / 4 for x in rows[k][1]], 2) for k in range(80)]  # a grid: equal distances, equal ids
    rows += [(2000, None, 1), (2001, [1.0] * 15 + [None], 1), (2002, [float("nan")] * 16, 1), (2003, [float("inf")] + [0.0] * 15, 1), (None, [0.5] * 16, 1)]
    got = check(spark, rows)
    assert len(got) == 150 + 90 + 80 + 1


def test_equal_first_vectors_leave_entries_unused(spark):
    check(spark, [(k, [0.5] * 8, 0) for k in range(20)] + [(30 + k, [k / 10] * 8, 0) for k in range(30)])


def test_fewer_rows_than_entries_and_one_row(spark):
    check(spark, some(5, dims=8))
    check(spark, some(1, dims=8))


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame(some(40), SCHEMA).selectExpr("*", "1 AS v", "2 AS code", "3 AS _x", "4 AS _l")
    assert sorted(map(str, map(tuple, vc.compress(df).collect()))) == sorted(map(str, brute(rounded(some(40)))))
    assert vc.compress(df.where("vec_id < 0")).collect() == []


def test_lengths_that_cannot_be_cut_alike_go(spark):
    rows = some(30)
    odd = [(100, [1.0] * 9, 0), (101, [1.0] * 8, 0), (102, [], 0)]
    got = vc.compress(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rounded(rows))))


def test_too_large_components_are_refused(spark):
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([(1, [1e30] * 8, 0)], SCHEMA))


@pytest.mark.parametrize("seed", range(6))
def test_trees_cache_and_prune_exactly(seed):
    rnd = np.random.default_rng(seed)
    points = rnd.integers(-3000, 3000, (1500, 6)) if seed % 2 else (rnd.normal(0, 900, (12, 6))[rnd.integers(0, 12, 1500)] + rnd.normal(0, 30, (1500, 6))).astype(np.int64)
    if seed == 4:
        points[200:900] = points[0]
    tree = vc.Balls.from_bytes(vc.Balls(points).to_bytes())
    assert sorted(tree.order.tolist()) == list(range(1500)) and (points[tree.order] == tree.points).all()
    for (a, b, left, right), c, s, r in zip(tree.nodes.tolist(), tree.centres, tree.sums, tree.radii):
        assert (tree.points[a:b].sum(0) == s).all() and ((tree.points[a:b] - c) ** 2).sum(1).max() <= r * r * (1 + 1e-9)
        if left >= 0:
            assert (tree.nodes[left][0], tree.nodes[left][1], tree.nodes[right][1]) == (a, tree.nodes[right][0], b)
        else:
            assert b - a <= vc.LEAF or r == 0
    book = points[rnd.integers(0, 1500, 16)]
    book[3] = book[9]
    dist = ((points[:, None] - book[None]) ** 2).sum(2)
    entry, near = tree.assign(book)
    assert (entry == dist.argmin(1)).all() and (near == dist.min(1)).all()
    sums, counts = tree.shares(book)
    for e in range(16):
        assert counts[e] == (entry == e).sum() and (sums[e] == points[entry == e].sum(0)).all()
    owned = sum(got[1] - got[0] for got in tree.walk(book) if len(got) == 4)
    assert owned > 300 or seed % 2  # on grouped points many are owned by whole balls


def test_decode_gives_the_named_entries(spark):
    rows = some(60)
    ints, length = vc.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    books = vc.first_books(ints, length)
    trees = vc.block_trees(ints, length)
    coded = vc.encode(trees, books)
    back = {r.vec_id: r.vector for r in vc.decode(coded, books).collect()}
    code = {r.vec_id: bytes.fromhex(r.code) for r in coded.collect()}
    assert all(back[i] == [x / 4096 for k in range(8) for x in books.books[k][code[i][k]]] for i in back) and len(back) == 60
    exact = {r.vec_id for r in coded.where("error = 0").collect()}
    assert exact >= set(range(16))  # the rows that the codebook starts from


def test_sql_agrees(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet')")
    got = op12_vector_codes(spark, d).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLE["op12_vector_codes"]).fetchall()) and len(got) == 500
