"""The training-data operators against plain Python versions on small tables:
given rows plus nulls, empty and long texts, ties, repeated rows, clashing
columns, and empty tables."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from upkeep.llm import bpe, chat, exact_dedup, html_extract, mixing, neighbours, queries, simhash, token_counts, toxicity, warc
from upkeep.llm.common import table, written

SF = "/root/testdata/sf0.001"
ODD = ["", None, "x<|endoftext|> y <|startoftext|>z <|end", "İstanbul ŉ ǅ Ω ΑΣ  　漢字 é \x1c\x1d a\x85b\xa0 \n\n  c",
       "don't I'LL we've 'S", "a" * 700 + " " + "ab" * 300, "日本語 123 ½ ² Ⅷ ٣", "  lead", "trail   ", "\t\t x\r\n\r\ny", "Same Text É", "same text É",
       "same text é", " ".join(f"w{i * 7919 % 1000}x" for i in range(3000)), "q" * 9000 + " z"]
NO_LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    """Given documents, odd texts, repeated rows, a null id; columns that clash with the operators' own."""
    base = table(spark, SF, "documents")
    extra = [(10 ** 6 + i, t, "en", "odd", 0) for i, t in enumerate(ODD)]
    extra += [(10 ** 6 + 50, "twice", None, None, None)] * 2 + [(None, "nobody", "xx", None, None)] * 2 + [(5, "twice", "en", "odd", 0)]
    clash = [F.lit(7).alias(c) for c in ("keep_id", "_rid", "_text", "block", "_fp", "n_tokens", "score")]
    return written(base.unionByName(spark.createDataFrame(extra, base.schema)).select("*", *clash), "test-docs")


@pytest.fixture(scope="module")
def rows(docs):
    # ids by way of object, so that null stays None
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_exact_dedup(docs, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t.translate(NO_LETTERS), []).append(i)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for n, i in enumerate(sorted(ids, key=lambda i: i != keep)):
            want[i, keep, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    for first, growth in ((32, 16), (9, 2)):
        got = exact_dedup.exact_dedup(docs, first_bytes=first, growth=growth)
        assert Counter(tuple(r) for r in got.collect()) == want


def brute_fingerprint(text, k):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text.translate(NO_LETTERS)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash(docs, rows):
    near = simhash.near_duplicates(docs.where("length(text) < 3000 or text is null"))
    some = [(i, t) for i, t in rows if len(t) < 3000]
    fps = [brute_fingerprint(t, 4) for _, t in some]
    want = Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(some, fps, brute_components(fps, [i for i, _ in some], 4)))
    assert Counter(tuple(r) for r in near.select("doc_id", "fingerprint", "component_id").collect()) == want


def test_simhash_links_of_a_dense_bucket(spark):
    """Thousands of fingerprints a few bits apart: every bucket is hashed again, no link is lost."""
    rng = np.random.default_rng(3)
    centre = [int(x) for x in rng.integers(0, 1 << 63, 3)]
    fps = sorted({c ^ (1 << int(a)) ^ (1 << int(b)) for c in centre for a, b in rng.integers(0, 63, (60, 2))})
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "_fp long"), 4, bucket_limit=32)
    edges = [tuple(r) for r in got.collect()]
    at = {f: n for n, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(at[a]), find(at[b]))] = min(find(at[a]), find(at[b]))
    assert [fps[find(n)] for n in range(len(fps))] == brute_components(fps, fps, 4)


def test_covering_masks_cover_every_pair_in_the_radius():
    masks = simhash.covering_masks(list(range(64)), 4)
    rng = np.random.default_rng(1)
    for _ in range(2000):
        bits = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(m & bits == 0 for m in masks)


def test_mixing(docs, rows):
    got = mixing.mix(docs, block_chars=500, period=64).toPandas()
    assert (got.groupby("_rid").epoch.min() == 0).all() and got["_rid"].nunique() == len(rows)
    assert ((got.slot >= got.release) & (got.slot < got.deadline)).all()
    per = got.drop_duplicates(["source", "block", "epoch"]).assign(source=lambda d: d.source.fillna("?"))
    assert per.slot.is_unique


@pytest.mark.parametrize("counts", [[1, 1, 62], [21, 21, 22], [3, 5, 7, 49], [1], [10, 20, 34]])
def test_pfair_period_stays_within_a_block(counts):
    plan, total = mixing.pfair_period(counts), sum(counts)
    done = [0] * len(counts)
    for n, (i, _, release, deadline, slot) in enumerate(plan, 1):
        assert slot == n - 1 and release <= slot < deadline
        done[i] += 1
        assert all(abs(done[s] - n * c / total) < 1 for s, c in enumerate(counts))


def test_mixing_to_given_weights(docs):
    got = mixing.mix(docs.where("source in ('src1', 'src2')"), weights={"src1": 3, "src2": 1}, block_chars=1, period=64).toPandas()
    assert set(got.source) == {"src1", "src2"} and (got.slot < got.deadline).all()


@pytest.mark.parametrize("weights", [[.5, .3, .15, .05], [(10_000 if i else 100_000) ** 0.7 for i in range(20)], [1 / 3, 1e-4, 7]])
def test_mixing_stays_within_a_block_of_the_weights_asked_for(weights):
    from fractions import Fraction

    done, total = [0] * len(weights), sum(map(Fraction, weights))
    share = [Fraction(w) / total for w in weights]
    for n, (i, j, release, deadline, slot) in zip(range(1, 60_001), mixing.pfair(mixing.whole(weights))):
        assert slot == n - 1 and j == done[i] and release <= slot < deadline
        done[i] += 1
        if n % 101 < 5:
            assert all(abs(done[k] - n * w) < 1 for k, w in enumerate(share))


def test_mix_follows_the_weights_over_many_thousand_blocks(spark):
    from fractions import Fraction

    weights = {"a": .5, "b": .3, "c": .15, "d": .05}
    rows = spark.range(24_000).selectExpr("id AS doc_id", "'x' AS text", "substr('aaaaaaaabbbbccdd', cast(id % 16 AS int) + 1, 1) AS source")
    got = mixing.mix(rows, weights=weights, block_chars=1, period=64).toPandas().sort_values("slot")
    assert list(got.slot) == list(range(len(got))) and len(got) > 30_000 and got.doc_id.nunique() == 24_000
    total = sum(map(Fraction, weights.values()))
    for s, w in weights.items():  # exact: a lag may come as near to one as a float can't tell
        assert all(abs(done - n * Fraction(w) / total) < 1 for n, done in enumerate((got.source == s).cumsum().tolist(), 1))


def test_mix_of_many_sources_holds_one_entry_per_weight(spark, monkeypatch):
    """One source per page: 3,000 sources of one block each and one of 500 keep their weights, scheduled as two."""
    rows = spark.range(3500).selectExpr("id AS doc_id", "'x' AS text", "if(id < 500, 'hot', concat('page', id)) AS source")
    held = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(mixing, "until_used", lambda w, n, f=mixing.until_used: held.add(len(w)) or f(w, n))
    got = mixing.mix(rows, block_chars=1).toPandas().sort_values("slot")
    assert held.value == 2 and got.doc_id.nunique() == 3500 and list(got.slot) == list(range(len(got)))
    assert ((got.slot >= got.release) & (got.slot < got.deadline)).all()
    total = 3000 + 500 ** 0.7
    for s, w in (("hot", 500 ** 0.7), ("page500", 1), ("page3499", 1)):
        assert np.abs((got.source == s).cumsum().to_numpy() - np.arange(1, len(got) + 1) * w / total).max() < 1 + 1e-9


def test_bpe_equals_the_library(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.TOKENIZER)
    name = bpe.lexicon(docs, max_words=500)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs, name).collect()) == want
    back = bpe.decode_documents(bpe.encode_documents(docs, name), name)
    assert Counter(tuple(r) for r in back.collect()) == Counter(rows)


def test_lexicon_shares_suffixes_and_misses_nothing(tmp_path):
    words = [(w.encode(), bytes([n, 0, 0, 0]) * (n % 3)) for n, w in enumerate(["walking", "talking", "walked", "talked", "a", "ab", "abc", "é"])]
    (tmp_path / "l").write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(tmp_path / "l"))
    assert [lexicon.get(w) for w, _ in words] == [ids for _, ids in words]
    assert [lexicon.get(w) for w in (b"", b"walk", b"walkings", b"b", b"\xc3")] == [None] * 5
    assert len(lexicon.first) - 1 < sum(len(w) for w, _ in words) // 2
    asked = [w for w, _ in words] + [b"", b"walk", b"walkings", b"b", b"\xc3", b"a" * 60]
    assert lexicon.get_many(asked) == [lexicon.get(w) for w in asked] and lexicon.get_many([]) == []
    (tmp_path / "e").write_bytes(bpe.compile_lexicon([]))
    assert bpe.Lexicon(str(tmp_path / "e")).get_many([b"a", b""]) == [None, None]


def test_many_words_merge_like_one():
    merges = bpe.Merges(bpe.TOKENIZER)
    rng = np.random.default_rng(2)
    words = [bytes(rng.choice(np.frombuffer(b"aabeinrst h\xc3\xa9", np.uint8), n).tolist()) for n in rng.integers(0, 90, 400)] + [b"", b"x", b"the", b" there", b"aaaaaaa"]
    assert merges.merge_many(words) == [np.array(bpe_quadratic(merges, w), "<u4").tobytes() for w in words]
    assert merges.merge_many([]) == [] and merges.merge_many([b""]) == [b""]


def test_codec_forgets_long_words_and_stays_bounded(monkeypatch):
    codec = bpe.Codec(bpe.TOKENIZER)
    monkeypatch.setattr(bpe, "_CACHED", 60)
    monkeypatch.setattr(bpe, "_GROUP", 50)
    texts = [f"word{i} {'z' * (i * 9)} <|endoftext|>é\n{i}" for i in range(60)]
    single = [bpe.Codec(bpe.TOKENIZER).encode_many([t])[0] for t in texts]
    assert codec.encode_many(texts) == single and codec.decode_many(single) == texts
    assert len(codec) <= 60 and max(map(len, codec)) <= 4 * bpe.LONGEST and "<|endoftext|>" in codec


def test_long_merges_equal_short_ones():
    merges = bpe.Merges(bpe.TOKENIZER)
    word = b"threatin" * 30
    assert merges._merge_long([merges.single[b] for b in word]) == bpe_quadratic(merges, word)


def bpe_quadratic(merges, word):
    ids = [merges.single[b] for b in word]
    while True:
        ranked = [(merges.pairs[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in merges.pairs]
        if not ranked:
            return ids
        (_, new), k = min(ranked)
        ids[k:k + 2] = [new]


def test_token_counts_equal_the_library(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.TOKENIZER)
    want = Counter((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in rows)
    got = token_counts.token_counts(docs, chunk_chars=1000, overlap=40, widen=3)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_warc_round_trip(spark):
    base = table(spark, SF, "pages")
    extra = [(5, "u", "dup"), (9, None, "dup"), (5, "u2", "dup"), (None, "n", None), (10 ** 6, "e\n", ""), (10 ** 6 + 1, "e", None), (None, "x", "dup")]
    pages = written(base.unionByName(spark.createDataFrame(extra, "page_id long, url string, html string")), "test-pages")
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    digest = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    first, seen, want = {}, set(), Counter()
    for i, p in rows:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    for i, p in rows:
        response = i is None or i == first[p] and (i, p) not in seen
        seen.add((i, p))
        want[i, len(p), digest(p), "response" if response else "revisit", None if response else first[p]] += 1
    got = warc.archive(pages, shard_bytes=1 << 17, roll_bytes=1 << 14)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_warc_files_do_not_depend_on_partitions(spark):
    from upkeep.llm.common import shared_path

    files = []
    for n in (1, 5):
        out = shared_path(spark, "warc-test")
        manifest = warc.write_warc(table(spark, SF, "pages").repartition(n), out, shard_bytes=1 << 17, roll_bytes=1 << 14)
        got = spark.read.format("binaryFile").load(f"{out}/part-*").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"))
        files.append(sorted(tuple(r) for r in got.collect()))
        assert manifest.agg(F.sum("records")).first()[0] == table(spark, SF, "pages").count()
    assert files[0] == files[1] and len(files[0]) > 2


def check_budget(windows, budget):
    """Every window's tokens are those of its formatted text, and over the budget only by the
    system turn and one new turn, which no window could hold in less."""
    count = token_counts.counter(token_counts.TOKENIZER).count
    for r in windows.collect():
        turns = chat.parse(r["formatted"])
        assert count(r["formatted"]) == r["tokens"]
        if r["tokens"] > budget:
            repeated = turns[:r["context"]]
            assert len(turns) - r["context"] == 1 and [role for role, _ in repeated] in ([], ["system"])


@pytest.mark.parametrize("words", [0, 100, 800, 1300])
def test_chat_windows_hold_the_budget_with_any_system_turn(spark, words):
    rng = np.random.default_rng(words)
    rows = [(1, 0, "system", " ".join(["rule"] * words))] if words else []
    rows += [(1, 1 + t, "user" if t % 2 == 0 else "assistant", " ".join(["### </turn> \\ word"] * int(rng.choice([1, 3, 10, 40, 90])))) for t in range(200)]
    windows = written(chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "test-budget")
    check_budget(windows, chat.BUDGET)
    got = windows.collect()
    if words < 800:
        assert max(r["tokens"] for r in got) > 600  # windows are filled
    if words:
        assert all(chat.parse(r["formatted"])[0][0] == "system" for r in got)
    assert sum(len(chat.parse(r["formatted"])) - r["context"] for r in got) == len(rows)


def test_chat_takes_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "ho")], "conv_id long, turn long, role string, text string")
    clash = rows.select("*", *[F.lit(7).alias(c) for c in ("window", "tokens", "_cost", "_rid", "_room", "_past", "loss")])
    assert chat.read_back(chat.format_windows(clash)).collect() == chat.read_back(chat.format_windows(rows)).collect()


def test_chat_round_trip(spark):
    given = table(spark, SF, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = "\\### Assistant: </turn> ok"
    long = " ".join(["word"] * 700)
    extra = [(-7, 0, "user", control), (-7, 1, "assistant", control), (-8, 0, "system", "be kind\\"), (-8, 1, "user", None), (-8, 2, "assistant", long),
             (-8, 3, "user", "\n</turn>\n### user\nx\\"), (-8, 4, "assistant", "#### \\\\n"), (-9, None, "a\nb\\n", "t"), (-9, None, None, ""), (-10, 0, "system", "only")]
    extra += [(-11, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " + "x y " * (t % 37)) for t in range(300)]
    rows = written(given.unionByName(spark.createDataFrame(extra, given.schema)), "test-conversations")
    plain = rows.toPandas().sort_values(["conv_id", "turn"], kind="stable", na_position="first")
    windows = written(chat.format_windows(rows, budget=256, history=40), "test-windows")
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    assert set(got) == set(plain.conv_id)
    for conv, turns in plain.groupby("conv_id"):
        text = ["" if t is None else t for t in turns.text]
        role = ["" if r is None else r for r in turns.role]
        loss = "".join(t for r, t in zip(role, text) if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in zip(role, text)).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    check_budget(windows, 256)
    assert windows.where("tokens > 256").count() > 0
    later = windows.where("conv_id = -8 and window > 0").collect()
    assert later and all(chat.parse(r["formatted"])[0] == ("system", "be kind\\") for r in later)
    # history: the turns before a window's first that start within 40 tokens of it, or fewer before a long turn
    count = token_counts.counter(token_counts.TOKENIZER).count
    turns = [(r["role"], r["text"]) for r in rows.where("conv_id = -11").orderBy("turn").collect()]
    starts = np.cumsum([0] + [count(f"### {r}\n{t}{chat.END}") for r, t in turns]).tolist()
    at = 0
    for r in windows.where("conv_id = -11").orderBy("window").collect():
        room = 256 - (starts[at + 1] - starts[at]) if r["window"] % 2 else 256
        history = [t for t in range(at) if starts[t] >= starts[at] - min(40, room)]
        got = chat.parse(r["formatted"])
        assert r["context"] == len(history) and got[:len(history)] == [turns[t] for t in history]
        at += len(got) - r["context"]
    assert at == len(turns)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="page"><div id="top-nav"><a href=/>Home</a> <a href=/x>News, all</a></div>
<header><h1>Site</h1></header><div class="wrap"><div class="sidebar"><p>Side, side, side text that is rather long, in fact as long as a paragraph of the article.</p></div>
<div class="cookie-notice">We use cookies, many.</div><div class="story"><h2>Title &amp; more</h2><p>First paragraph, with commas, &lt;b&gt; and&nbsp;  spaces
and a <a href=/l>link</a> in it, long enough to score.<p>Second <b>one<br>here</b>, unclosed, also of some length so that it counts.</p>
<script>if (a < b) { document.write("</p>") }</script><form><input name=q>Search, please</form><ul><li>Point one<li>Point two</ul><div class="ad-slot">Buy, buy</div></div>
<div id="comments"><p>Reader: nice, very nice, this comment is long, longer than the article, even, with commas, lots, of, them.</p></div></div>
<aside>Aside</aside><footer>&copy; x</footer></body></html>"""


def test_html_extraction_of_a_page_without_article():
    assert html_extract.extract(PAGE) == ("Title & more\nFirst paragraph, with commas, <b> and spaces and a link in it, long enough to score.\n"
                                          "Second one here, unclosed, also of some length so that it counts.\nPoint one\nPoint two")


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>cut <b", "cut"), ("<article><p>a<p>b</article>", "a\nb"),
                                        ("<!-- x --><p>a&am", "a&am"), ("<script>x", ""), ("<p title='a>b'>c</p>", "c"), ("<nav>menu</nav>", "")])
def test_html_extraction_of_odd_input(html, text):
    assert html_extract.extract(html) == text


LONG = [f"Long paragraph {i}, with commas, clauses, and enough words in it that it passes a good many points to its section, more than others." for i in range(10)]


@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>", "<section><div>{}</div></section>"])
def test_html_extraction_of_text_spread_unevenly(wrap):
    """Without article or main: short sections, lists, tables and h3 to h6 beside the section that holds most of the text stay."""
    page = ("<body><div class=menu><a href=/>Home</a></div><div id=content>" + wrap.format("<div>" + "".join(f"<p>{x}</p>" for x in LONG) + "</div>")
            + "<div><h2>Short</h2><p>One short paragraph.</p></div><h3>Points</h3><ul><li>One<li>Two</ul><h6>Figures</h6><table><tr><td>1<td>2</table></div>"
            + "<div><h3>Elsewhere</h3><ul><li><a href=/a>Other page</a><li><a href=/b>Another page</a></ul></div><div><p>Afterword.</p></div></body>")
    assert html_extract.extract(page).split("\n") == LONG + ["Short", "One short paragraph.", "Points", "One", "Two", "Figures", "1", "2", "Afterword."]


def test_html_extraction_of_the_pages(spark):
    """Against the articles cut out of the known page layout."""
    import html
    import re

    got = html_extract.extract_text(table(spark, SF, "pages")).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect()
    assert len(got) == table(spark, SF, "pages").count()
    for r in got:
        inner = " ".join(r["html"].partition("<article>")[2].partition("</article>")[0].split("\n"))
        inner = re.sub(r"<[^>]*$", "", re.sub(r"<[^>]*>", " ", re.sub(r"</?(h1|p)>", "\n", inner)))
        assert r["text"] == "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in inner.split("\n")) if x)
        assert r["n_chars"] == len(r["text"])


def test_toxicity_is_learned_from_document_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    assert ((got.score >= 0) & (got.score <= 1) & (got.predicted == (got.score >= 0.7))).all()
    held = got[got.held_out]
    assert len(held) > 1000 and held[held.predicted == 1].toxic.mean() > 0.9 and held[held.toxic == 1].predicted.mean() > 0.7
    import zlib
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))


def test_toxicity_locates_sentences_and_takes_odd_rows(spark, docs):
    model = {"features": ["vile", "vile*"], "weights": np.array([6.0, 6.0]), "bias": -8.0}
    rows = spark.createDataFrame([(1, "All good here. You are vile! Bye."), (None, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(rows, model).collect()}
    (bad,) = got[1]["offending"]
    assert "All good here. You are vile! Bye."[bad["start"]:bad["end"]].strip() == "You are vile" and got[1]["predicted"] == 1
    assert got[3]["score"] < 0.1 and got[None]["predicted"] == 0
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(docs, none).where("predicted = 1").isEmpty()


def test_toxicity_trains_on_one_row_per_id(spark, monkeypatch):
    rows = [(i % 50, f"You are vile and {i % 50}!" if i % 2 else "All good here.") for i in range(200)] + [(0, "Flood of rows.")] * 500
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, n: seen.append(len(rows)) or fit(rows, n))
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, train_rows=30)
    assert seen == [min(30, labels.where(~toxicity.held_out("doc_id")).count())]


def test_repeated_query_rows_have_neighbours_of_their_own(spark):
    base = table(spark, SF, "embeddings").select("vec_id", "embedding")
    once = neighbours.nearest(base, lambda i: i == 20).toPandas()
    twice = neighbours.nearest(base.unionByName(base.where("vec_id = 20")), lambda i: i == 20).toPandas()
    assert sorted(twice["rank"]) == sorted(list(range(1, 21)) * 2)
    assert twice.vec_id.nunique() == 20 and set(twice.vec_id) == set(once.vec_id)


def test_equal_vectors_have_equal_scores_and_ties_go_to_the_smaller_id(spark):
    """Copies in every block and at every place of a block: the order is that of sums in component order."""
    g = np.random.default_rng(5)
    vecs = g.standard_normal((900, 24))
    vecs[100:] = vecs[g.integers(0, 100, 800)]  # every vector about nine times
    rows = list(enumerate(vecs.tolist())) + [(None, vecs[3].tolist())]
    for block_rows in (64, 301, 5000):
        got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), lambda i: i % 20 == 0, k=30, block_rows=block_rows).toPandas()
        for q in range(0, 900, 20):
            mine = got[got.query_id == q].sort_values("rank")
            scores = {}
            for i, v in rows:
                s = 0.0
                for a, b in zip(v, rows[q][1]):
                    s += a * b
                scores[i] = s
            order = sorted((i for i, _ in rows if i != q), key=lambda i: (-scores[i], i is None, i or 0))[:30]
            found = [None if pd.isna(i) else int(i) for i in mine.vec_id]
            assert list(mine.score) == [scores[i] for i in found] and len(found) == 30
            assert found == sorted(found, key=lambda i: (-scores[i], i is None, i or 0))
            missed = [i for i in order if i not in found]
            assert len(missed) <= 6 and (missed or found == order)


def test_neighbours_take_clashing_columns(spark):
    base = table(spark, SF, "embeddings").select("vec_id", "embedding")
    clash = base.select("*", *[F.lit(7).alias(c) for c in ("id", "v", "_rid", "block", "set", "score", "rank")])
    assert neighbours.nearest(clash, lambda i: i % 100 == 0).collect() == neighbours.nearest(base, lambda i: i % 100 == 0).collect()


def test_nearest_neighbours(spark):
    base = table(spark, SF, "embeddings")
    odd = [(100_000, None), (100_020, []), (100_040, [0.0] * 64), (100_060, [float("nan")] * 64), (100_080, [None] * 64), (100_100, [float("inf")] * 64),
           (100_120, [2.0] + [0.5] * 63), (100_121, [2.0] + [0.5] * 63), (100_122, [2.0] + [0.5] * 63), (None, [0.1] * 64), (100_140, [1.0, 2.0])]
    rows = base.select("vec_id", "embedding").unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>"))
    got = neighbours.nearest(rows, lambda i: i % 20 == 0, block_rows=300, query_rows=16).toPandas()
    vecs = {}
    for r in rows.collect():
        v = r["embedding"]
        if v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            vecs[r["vec_id"]] = np.array(v, dtype=float)
    hits = total = 0
    for q in (i for i in vecs if i is not None and i % 20 == 0):
        scored = sorted((-float(vecs[q] @ v), i is None, i or 0) for i, v in vecs.items() if i != q)[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21))
        assert np.allclose(mine.score, [vecs[q] @ vecs[None if pd.isna(i) else int(i)] for i in mine.vec_id], rtol=1e-12)
        hits += len({(n, i) for _, n, i in scored} & {(pd.isna(i), 0 if pd.isna(i) else int(i)) for i in mine.vec_id})
        total += 20
    assert hits / total >= 0.9 and not set(got.query_id) & {100_020, 100_040, 100_140}


@pytest.mark.parametrize("lengths", ["even", "lognormal .3", "lognormal 1", "1 % longer"])
def test_nearest_neighbours_of_uneven_lengths(spark, lengths):
    g = np.random.default_rng(3)
    vecs = g.standard_normal((2000, 64))
    vecs /= np.linalg.norm(vecs, axis=1)[:, None]
    vecs *= {"even": np.ones(2000), "lognormal .3": g.lognormal(0, .3, 2000), "lognormal 1": g.lognormal(0, 1, 2000),
             "1 % longer": np.where(np.arange(2000) % 100 == 7, 3, 1)}[lengths][:, None]
    got = neighbours.nearest(spark.createDataFrame(list(enumerate(vecs.tolist())), "vec_id long, embedding array<double>"),
                             lambda i: i % 20 == 0, block_rows=1000).toPandas()
    scores = vecs @ vecs.T
    np.fill_diagonal(scores, -np.inf)
    hits = sum(len(set(np.argsort(-scores[q])[:20]) & set(got[got.query_id == q].vec_id)) for q in range(0, 2000, 20))
    assert len(got) == 2000 and hits >= 0.96 * 2000


def test_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for got in (exact_dedup.exact_dedup(docs), simhash.near_duplicates(docs), mixing.mix(docs), token_counts.token_counts(docs),
                bpe.round_trip(docs, bpe.lexicon(docs)), html_extract.extract_text(table(spark, SF, "pages").limit(0)),
                warc.archive(table(spark, SF, "pages").limit(0)), chat.read_back(chat.format_windows(table(spark, SF, "conversations").limit(0))),
                neighbours.nearest(table(spark, SF, "embeddings").limit(0), lambda i: i % 20 == 0),
                toxicity.score(docs, toxicity.train(docs, table(spark, SF, "labels")))):
        assert got.count() == 0
