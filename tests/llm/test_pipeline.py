"""The pipeline's stages, each against a plain Python version of its rule on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from upkeep.llm import bpe, simhash, toxicity
from upkeep.llm.common import table, written

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    base = table(spark, SF, "documents")
    odd = [(10 ** 6, "Same Text here", None, None, None), (10 ** 6, "same text HERE", "en", "odd", 1), (None, "nobody", None, None, None), (10 ** 6 + 1, None, "en", "odd", 0)]
    docs = written(base.unionByName(spark.createDataFrame(odd, base.schema)), "test-pipeline")
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        outs.append(written(stage(spark, docs if not outs else outs[-1], SF), "test-stage"))
    clean, unique, apart, mixed, encoded = outs
    for out in outs[:-1]:
        assert out.columns == base.columns
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    bad = toxicity.score(docs, toxicity.train(docs, table(spark, SF, "labels"))).where("predicted = 1")
    assert docs.count() - clean.count() == bad.count() > 0
    # exact: one row of each text, with the largest id
    texts = {}
    for r in clean.collect():
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        texts.setdefault(t, []).append(-1 if r["doc_id"] is None else r["doc_id"])
    assert Counter(max(ids) for ids in texts.values()) == Counter(-1 if r["doc_id"] is None else r["doc_id"] for r in unique.collect())
    # near: the smallest id of each component
    got = unique.select("doc_id", "text").collect()
    fps = [simhash.fingerprint((r["text"] or "").encode(), 4) for r in got]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for n, r in enumerate(got):
        i = r["doc_id"]
        if find(n) not in least or (i is not None and (least[find(n)] is None or i < least[find(n)])):
            least[find(n)] = i
    assert Counter(least.values()) == Counter(r["doc_id"] for r in apart.collect())
    # mix: every row, perhaps more than once
    assert set(rows(mixed)) == set(rows(apart))
    codec = bpe.Codec(bpe.TOKENIZER)
    assert Counter((r["doc_id"], len(codec.encode(r["text"] or "")) // 4) for r in mixed.collect()) == \
        Counter((r["doc_id"], r["n_tokens"]) for r in encoded.collect())
    assert corpus_pipeline.ORACLE_SQL is None
