"""URL filters against every rule tried on every URL, by index and by join."""

import os
import re

import duckdb
import pytest

from upkeep.llm import url_rules
from upkeep.llm.queries import ORACLE, URL_RULES, op13_url_rules

URLS = ["https://a.example.org/es/1", "HTTPS://A.EXAMPLE.ORG/ES/1", "http://example.org/en/1", "http://example.org/en/1210?x=/es/", "http://example.org/en/21",
        "http://notexample.org/es/1", "http://org/", "http://org", "http://x.org?q", "http://x.org#/es/", "http://b.com/fr/x#y", "http://com/de/", "http://b.com/de",
        "http://b.com/it/", "no scheme/es/", "", None, "://", "http://example.org.com/fr/", "http://example.org:80/es/1", "ftp://u@example.org/es/1",
        "http://é.org/é", "http://a.org\n/x", "http://a.org/" + "seg/" * 60_000, "x://y://example.org/es/", "http://exa*mple.org/es/"]


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def fits(rule, host, path):
    """Without expressions: wildcards by trying every split."""
    def glob(pattern, text, prefix):
        if not pattern:
            return prefix or not text
        if pattern[0] == "*":
            return any(glob(pattern[1:], text[k:], prefix) for k in range(len(text) + 1))
        return bool(text) and text[0] == pattern[0] and glob(pattern[1:], text[1:], prefix)

    labels = [host] + [host[m.end():] for m in re.finditer(r"\.", host)]
    return (rule[0] == "" or any(glob(rule[0], part, False) for part in labels)) and glob(rule[1], path, True)


def brute(rules, url, default="allow"):
    host, path = cut(url)
    got = [r for r in rules if fits(r, host, path)]
    if not got:
        return host, path, None, default
    best = min(got, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block", r[0] + r[1]))
    return host, path, best[0] + best[1], best[2]


MORE = URL_RULES + [("", "/ad*", "block"), ("*mple.org", "/e", "block"), ("x.org", "", "block"), ("b.com", "*x", "allow"), ("a.org", "/seg/", "block"),
                    ("com", "/fr/x", "allow"), ("com", "/fr/x", "block"), ("", "", "block"), ("c.d", "x", "block"), ("é.org", "/é", "block")]


def frame(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


@pytest.mark.parametrize("rules,index_bytes", [(URL_RULES, 1 << 20), (URL_RULES, 0), (MORE, 1 << 20), (MORE, 0), (MORE[:-3], 1 << 20), ([], 1 << 20), ([], 0)])
def test_against_all_rules(spark, rules, index_bytes):
    got = url_rules.judge(frame(spark, URLS), spark.createDataFrame(rules, url_rules.RULES), index_bytes=index_bytes).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {k: brute(rules, u) for k, u in enumerate(URLS)} and len(got) == len(URLS)


def test_filed_under_the_rarest_token(spark):
    urls = frame(spark, ["http://news.example.org/en/"] * 9 + ["http://example.com/en/x"])
    urls = urls.select(url_rules.host_of(urls.url).alias("host"), url_rules.path_of(urls.url).alias("path"))
    rules = spark.createDataFrame([("example.com", "/en/x", "block"), ("news.example.org", "/en/", "block"), ("", "/n*", "block")], url_rules.RULES)
    got = {r.rule: r.token for r in url_rules.rule_index(urls, rules).collect()}
    assert got == {"example.com/en/x": "com", "news.example.org/en/": "news", "/n*": ""}  # 'x' may go on, so it is no token


def test_tokens_every_fitting_url_has():
    assert url_rules.tokens_of("example.org", "/en/1") == ["en", "example", "org"]
    assert url_rules.tokens_of("*ple.org", "/a*b/c-d/") == ["c", "d", "org"]
    assert url_rules.tokens_of("x.org", "") == ["org", "x"] and url_rules.tokens_of("", "/*") == []


def test_repeated_rows_extra_columns_empty_table(spark):
    rules = spark.createDataFrame(URL_RULES, url_rules.RULES)
    pages = spark.createDataFrame([(1, URLS[0]), (1, URLS[0]), (None, None)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS _file", "4 AS token")
    for size in (0, 1 << 20):
        got = url_rules.judge(pages, rules, index_bytes=size)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, *brute(URL_RULES, URLS[0]))] * 2 + [(None, "", "", None, "allow")]))
        assert url_rules.judge(pages.where("page_id = 5"), rules, index_bytes=size).collect() == []


def test_sql_agrees(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{d}/pages.parquet')")
    got = op13_url_rules(spark, d).collect()
    want = con.execute(ORACLE["op13_url_rules"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    by_rule = {(r.page_id): tuple(r)[1:] for r in got}
    pages = con.execute("SELECT page_id, url FROM pages").fetchall()
    assert by_rule == {p: brute(URL_RULES, u) for p, u in pages}
    assert {v for *_, v in by_rule.values()} == {"allow", "block"}
