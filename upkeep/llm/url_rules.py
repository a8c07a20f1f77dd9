"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a host, a path prefix and a verdict. It fits its host and every
subdomain, if the URL's path starts with its path; ``*`` in either stands for any
characters (in a host: without ``/``). An empty host fits every host. The longest
fitting rule (host and path together) decides; of equally long ones that with the
longer host, then ``block``, then the smaller text.

A rule becomes a regular expression and a set of literal tokens: runs of letters
and digits A-Z, a-z, 0-9 that every fitting URL must hold whole, so a run next to
a ``*`` or at the end of the path is none. How often each of these tokens occurs
is counted over all URLs, and the rule is filed under its rarest one; a rule
without tokens is filed under the empty token, which every URL has. A URL's
tokens fetch the rules filed under them, and only those run their expression,
longest first.

Rules of up to ``index_bytes`` in all, measured before, travel to the workers as
an index; beyond that the index stays a table that the URLs' tokens are joined
with, with equal results. URLs that no rule fits get ``default``.

Cases: a null url or one without ``://`` has an empty host and path; a URL
without a path (``http://a.org``) has an empty path, which does not start with
``/``; ids may be null or repeated, every row is judged by itself; very long
URLs are read whole; an empty table gives no rows; without rules every row gets
the default; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import ascii_lower, written

INDEX_BYTES = 32 << 20
RULES = "host string, path string, verdict string"
_TOKEN = "[A-Za-z0-9]+"
_COMPILED = "rule string, verdict string, pattern string, tokens array<string>, rank struct<size:int,host:int,block:boolean>"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def pattern_of(host: str, path: str) -> str:
    """The expression of a rule, over a URL's host and path put together; the same
    text is valid here and in the JVM."""

    def literal(text: str, star: str) -> str:
        return "".join(star if c == "*" else c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)

    front = r"^(?:[^/]*\.)?" + literal(host, "[^/]*") if host else "^[^/]*"
    return front + "(?![^/])" + literal(path, r"[\s\S]*")


def tokens_of(host: str, path: str) -> list[str]:
    """The literal tokens of a rule."""
    text = host + path
    found = set()
    for m in re.finditer(_TOKEN, text):
        whole_left = m.start() > 0 and text[m.start() - 1] != "*" or m.start() == 0 and bool(host)
        whole_right = m.end() < len(text) and text[m.end()] != "*" or m.end() == len(text) and not path
        if whole_left and whole_right:
            found.add(m[0])
    return sorted(found)


def compiled(rules: DataFrame) -> DataFrame:
    """``rule, verdict, pattern, tokens, rank`` of each distinct rule; null hosts and
    paths count as empty."""
    rows = rules.select(F.coalesce(ascii_lower(F.col("host")), F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()

    def run(batches):
        for b in batches:
            out = []
            for host, path, verdict in zip(*(b.column(c).to_pylist() for c in ("host", "path", "verdict"))):
                out.append({"rule": host + path, "verdict": verdict, "pattern": pattern_of(host, path), "tokens": tokens_of(host, path),
                            "rank": {"size": len(host + path), "host": len(host), "block": verdict == "block"}})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return rows.mapInArrow(run, _COMPILED)


_ARROW = pa.schema([("rule", pa.string()), ("verdict", pa.string()), ("pattern", pa.string()), ("tokens", pa.list_(pa.string())),
                    ("rank", pa.struct([("size", pa.int32()), ("host", pa.int32()), ("block", pa.bool_())]))])


def _url_tokens() -> Column:
    return F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(_TOKEN), F.lit(0)))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``token, rule, verdict, pattern, rank``: each rule under its rarest literal
    token over all ``urls`` (host, path), the smaller of equally rare ones."""
    ready = written(compiled(rules), "rules")
    wanted = ready.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode(_url_tokens()).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    key = (ready.select("pattern", F.explode_outer("tokens").alias("token")).join(seen, "token", "left")
           .groupBy(F.col("pattern").alias("_p")).agg(F.min_by(F.coalesce("token", F.lit("")), F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")))
    return written(ready.join(key, F.col("pattern") == F.col("_p")).select("token", "rule", "verdict", "pattern", "rank"), "rule-index")


class Index:
    """Rules by token, longest first; ``best`` runs the fetched ones."""

    def __init__(self, rows: list[tuple[str, str, str, str, tuple]]):
        self.by_token: dict[str, list] = {}
        order = {id(r): k for k, r in enumerate(sorted(rows, key=lambda r: (*(-x for x in r[4]), r[1])))}
        for r in sorted(rows, key=lambda r: order[id(r)]):
            self.by_token.setdefault(r[0], []).append((order[id(r)], re.compile(r[3]), r[1], r[2]))
        self.last = len(rows)

    def best(self, text: str) -> tuple[str | None, str | None]:
        least, found = self.last, (None, None)
        for token in {"", *_find(text)}:
            for place, pattern, rule, verdict in self.by_token.get(token, ()):
                if place >= least:
                    break
                if pattern.match(text):
                    least, found = place, (rule, verdict)
                    break
        return found


_find = re.compile(_TOKEN).findall


def judge_by_index(urls: DataFrame, index: DataFrame, default: str) -> DataFrame:
    """Adds ``rule`` and ``verdict``; the index travels to the workers."""
    rows = [(r.token, r.rule, r.verdict, r.pattern, (r.rank.size, r.rank.host, r.rank.block)) for r in index.collect()]

    def run(batches):
        ready = Index(rows)
        for b in batches:
            got = [ready.best(h + p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            columns = [*b.columns, pa.array([r for r, _ in got], pa.string()), pa.array([default if r is None else v for r, v in got], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "rule", "verdict"])

    return urls.mapInArrow(run, urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).schema)


def judge_by_join(urls: DataFrame, index: DataFrame, default: str) -> DataFrame:
    """The same by an equi join of tokens, for an index of any size. Rows are told
    apart by their place in a written table."""
    rows = written(urls, "urls").select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    text = F.concat("host", "path")
    asked = rows.select("_file", "_at", text.alias("_text"), F.explode(F.array_union(F.array(F.lit("")), _url_tokens())).alias("_token"))
    fits = asked.join(index, F.col("_token") == F.col("token")).where(F.expr("rlike(_text, pattern)"))
    first = F.struct(-F.col("rank.size"), -F.col("rank.host"), ~F.col("rank.block"), "rule")
    best = fits.groupBy(F.col("_file").alias("_f"), F.col("_at").alias("_a")).agg(F.min_by(F.struct("rule", "verdict"), first).alias("_best"))
    return (rows.join(best, (F.col("_file") == F.col("_f")) & (F.col("_at") == F.col("_a")), "left")
            .select(*urls.columns, F.col("_best.rule").alias("rule"), F.when(F.col("_best").isNull(), F.lit(default)).otherwise(F.col("_best.verdict")).alias("verdict")))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
          index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; ``rules`` has ``host, path, verdict``."""
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    index = rule_index(urls, rules)
    size = index.agg(F.sum(F.octet_length("token") + F.octet_length("rule") + F.octet_length("pattern") + 32)).first()[0] or 0
    return (judge_by_index if size <= index_bytes else judge_by_join)(urls, index, default)
