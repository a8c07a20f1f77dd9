"""DuckDB statements of the operators that SQL can express."""

from __future__ import annotations

URL_RULES = """
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
urls AS MATERIALIZED (SELECT page_id, row_number() OVER () AS rid,
                translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT rid, r.host || r.path AS rule, r.verdict,
                row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
         FROM urls u JOIN rules r ON (u.host = r.host OR suffix(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM urls u LEFT JOIN fits f ON f.rid = u.rid AND f.place = 1
"""


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


MERKLE_MANIFEST = f"""
WITH RECURSIVE
steps8(b, v, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL
                    SELECT b, xor(v >> 1, 3988292384 * (v & 1)), k + 1 FROM steps8 WHERE k < 8),
crc_table AS MATERIALIZED (SELECT b, v FROM steps8 WHERE k = 8),
docs AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM documents),
crc(rid, s, i, c) AS (SELECT rid, doc_id::VARCHAR, 1, 4294967295 FROM docs WHERE doc_id IS NOT NULL UNION ALL
                      SELECT rid, s, i + 1, xor(c >> 8, v) FROM crc JOIN crc_table ON b = (xor(c, ascii(substr(s, i, 1))) & 255) WHERE i <= length(s)),
marked AS MATERIALIZED (SELECT rid FROM crc WHERE i > length(s) AND xor(c, 4294967295) % 7 = 0),
hashed AS MATERIALIZED (SELECT rid, doc_id, lang, {_leaf('n_chars')} AS leaf,
                               CASE WHEN rid IN (SELECT rid FROM marked) THEN {_leaf('(n_chars + 1)')} END AS altered FROM docs),
leaves AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
                               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                               count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes(g, lvl, pos, n, node) AS (SELECT g, 0, pos, n, leaf FROM leaves UNION ALL
                                SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
                                FROM nodes WHERE n > 1 GROUP BY g, lvl, pos // 2, n),
subroots AS MATERIALIZED (SELECT g, node, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, pos, n, node) AS (SELECT 0, g, n, node FROM subroots UNION ALL
                            SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
                            FROM tops WHERE n > 1 GROUP BY lvl, pos // 2, n),
sides AS (SELECT l.rid, 0 AS tree, h.lvl, h.pos % 2 AS side, s.node AS sibling
          FROM leaves l JOIN nodes h ON h.g = l.g AND h.n > 1 AND h.pos = l.pos >> h.lvl
          LEFT JOIN nodes s ON s.g = h.g AND s.lvl = h.lvl AND s.pos = xor(h.pos, 1)
          UNION ALL
          SELECT l.rid, 1, h.lvl, h.pos % 2, s.node FROM leaves l JOIN tops h ON h.n > 1 AND h.pos = l.g >> h.lvl
          LEFT JOIN tops s ON s.lvl = h.lvl AND s.pos = xor(h.pos, 1)),
way AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY tree, lvl) AS k FROM sides),
fold(rid, k, node) AS (SELECT rid, 0, coalesce(altered, leaf) FROM leaves UNION ALL
                       SELECT f.rid, w.k, sha256(CASE WHEN sibling IS NULL THEN node WHEN side = 1 THEN sibling || node ELSE node || sibling END)
                       FROM fold f JOIN way w ON w.rid = f.rid AND w.k = f.k + 1),
ends AS (SELECT rid, arg_max(node, k) AS folded FROM fold GROUP BY rid),
proof AS (SELECT rid, string_agg(sibling, '' ORDER BY k) AS p FROM way GROUP BY rid),
root AS (SELECT node AS root FROM tops WHERE n = 1)
SELECT l.doc_id, l.leaf, s.node AS subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves l JOIN subroots s ON s.g = l.g JOIN ends e ON e.rid = l.rid LEFT JOIN proof ON proof.rid = l.rid CROSS JOIN root
"""


def _vector_codes(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    out = [f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
places AS (SELECT rid, unnest(v) AS x, unnest(range(len(v))) AS i, len(v) // {parts} AS w FROM kept),
cut AS MATERIALIZED (SELECT rid, i // w AS part, i % w AS pos, x FROM places),
firsts AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM kept),
c0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM cut JOIN firsts USING (rid) WHERE entry < {entries})"""]
    for k in range(rounds + 1):
        out.append(f"""
d{k} AS (SELECT rid, part, entry, sum((x - c) * (x - c)) AS d FROM cut JOIN c{k} USING (part, pos) GROUP BY rid, part, entry),
a{k} AS MATERIALIZED (SELECT rid, part, min(d::HUGEINT * {entries} + entry) AS best FROM d{k} GROUP BY rid, part)""")
        if k < rounds:
            out.append(f"""
m{k} AS (SELECT part, best % {entries} AS entry, pos, sum(x)::HUGEINT AS s, count(*) AS n FROM a{k} JOIN cut USING (rid, part) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{k} LEFT JOIN m{k} USING (part, entry, pos))""")
    out.append(f"""
sha AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds}),
per AS (SELECT rid, string_agg(printf('%02x', (best % {entries})::INTEGER), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM per JOIN kept USING (rid) CROSS JOIN sha
""")
    return ",".join(out[:-1]) + "," + out[-1]


VECTOR_CODES = _vector_codes()
