"""The Merkle manifest against a plain tree built row by row."""

import hashlib
import os
import zlib

import duckdb
import pytest

from upkeep.llm import merkle
from upkeep.llm.queries import ORACLE, op11_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, n_chars):
    return h(field(row["doc_id"]), field(row["source"]), field(row["lang"]), field(n_chars), field(row["text"]))


def climb(nodes):
    """The root of a list of nodes, and each node's siblings with their side, level by level."""
    at, trails = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, p in enumerate(at):
            trails[k].append((p % 2, nodes[p ^ 1] if p ^ 1 < len(nodes) else ""))
        nodes = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        at = [p // 2 for p in at]
    return (nodes[0] if nodes else None), trails


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["n_chars"])))
        made[name] = climb([leaf(r, r["n_chars"]) for r in groups[name]])
    root, above = climb([made[name][0] for name in names])
    out = []
    for name, top in zip(names, above):
        for r, trail in zip(groups[name], made[name][1]):
            trail = trail + top
            marked = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf(r, r["n_chars"] + 1 if marked and r["n_chars"] is not None else r["n_chars"])
            for right, s in trail:
                node = h(s, node) if right else h(node, s)
            out.append((r["doc_id"], leaf(r, r["n_chars"]), made[name][0], root, h(*[s for _, s in trail]), node, node == root))
    return out


def rows_of(n):
    langs = ["en", "en", "en", None, "", "é", "z", "de"]
    rows = [dict(doc_id=k * 5 % n if k % 11 else None, text=None if k % 13 == 0 else "" if k % 17 == 0 else f"tëxt {k % 40}", lang=langs[k * k % 8 if k > 2 else 1],
                 source=None if k % 19 == 0 else f"s{k % 3}", n_chars=None if k % 6 == 0 else k) for k in range(n)]
    return rows + [dict(doc_id=n + 1, text="x" * 300_000, lang="only", source="s", n_chars=1)]


@pytest.mark.parametrize("n,every", [(1, 6), (3, 2), (150, 1), (150, 3), (403, 6)])
def test_against_a_plain_tree(spark, n, every):
    rows = rows_of(n)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle.proofs(merkle.manifest(merkle.document_leaves(docs), every=every)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    if n > 100:
        assert {r.verified for r in got} == {True, False}


def test_repeated_rows_and_clashing_names(spark):
    rows = [dict(doc_id=7, text="a", lang="en", source="s", n_chars=k // 2) for k in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS pos", "3 AS _group", "4 AS path", "5 AS n")
    got = merkle.proofs(merkle.manifest(merkle.document_leaves(docs), every=2)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.proofs(merkle.manifest(merkle.document_leaves(docs))).collect() == []


def test_only_every_few_levels_is_stored(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    tree = merkle.manifest(merkle.document_leaves(docs), every=4)
    assert [level.count() for level in tree.levels] == [300, 19, 2, 1]


def test_one_changed_field_changes_the_root(spark):
    docs = spark.createDataFrame(rows_of(60), SCHEMA)
    root = [merkle.proofs(merkle.manifest(merkle.document_leaves(d))).first().root
            for d in (docs, docs.selectExpr("doc_id", "if(doc_id = 10, 'other', text) AS text", "lang", "source", "n_chars"))]
    assert root[0] != root[1]


def test_sql_agrees(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    got = op11_merkle_manifest(spark, d)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE['op11_merkle_manifest']})").fetchall()
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(want) and len(want) == 200
