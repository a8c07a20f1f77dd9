"""DuckDB SQL text for the package's Column expressions.

Used only to write the independent oracle queries that the correctness check
runs next to the Spark plans; nothing in the Spark path depends on it.
"""

from __future__ import annotations

from upkeep.functions.text import BUILDING_ABBREV, BUILDING_ALIASES, NON_BUILDING_PATTERNS


EMPTY = "''"
WS = "'\\s+'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip_chars(x: str, cls: str) -> str:
    return f"regexp_replace({x}, '^[{cls}]+|[{cls}]+$', '', 'g')"


def normalize_building(x: str) -> str:
    s0 = strip_ws(f"coalesce(CAST({x} AS VARCHAR), '')")
    s = strip_ws(f"regexp_replace({s0}, '(?i)^location:\\s*', '')")
    total = " OR ".join(f"contains(lower({s}), {q(p)})" for p in NON_BUILDING_PATTERNS)
    t = strip_chars(f"regexp_replace({s}, '(?i)\\b(room|rm|suite|ste|apt)\\b.*$', '')", " \\-,:")
    t = strip_ws(strip_chars(f"regexp_replace({t}, '\\s+\\d+[a-zA-Z0-9-]*$', '')", " \\-,:"))
    alias = "CASE lower(" + t + ") " + " ".join(
        f"WHEN {q(k.lower())} THEN {q(v)}" for k, v in BUILDING_ALIASES.items()) + f" ELSE {t} END"
    return (f"(CASE WHEN {s} = '' OR {total} OR regexp_full_match({s}, '[\\d:\\s]+') THEN '' "
            f"ELSE {alias} END)")


def replace_status(labor: str, parts: str, price: str) -> str:
    p = f"coalesce(CAST({price} AS DOUBLE), 0.0)"
    spent = f"(coalesce({labor}, 0.0) + coalesce({parts}, 0.0))"
    return (f"(CASE WHEN {p} <= 0 THEN 'Good' WHEN {spent} >= 0.8::DOUBLE * {p} THEN 'Replace' "
            f"WHEN {spent} >= 0.6::DOUBLE * {p} THEN 'Monitor' ELSE 'Good' END)")


def life_status(age: str, life: str) -> str:
    return (f"(CASE WHEN {age} IS NULL OR {life} IS NULL OR {life} <= 0 THEN NULL "
            f"WHEN {age} / {life} >= 1.0::DOUBLE THEN 'Replace' "
            f"WHEN {age} / {life} >= 0.8::DOUBLE THEN 'Monitor' ELSE 'Good' END)")


def status_rank(s: str) -> str:
    return f"(CASE WHEN {s} = 'Replace' THEN 2 WHEN {s} = 'Monitor' THEN 1 ELSE 0 END)"


def combine_status(*s: str) -> str:
    r = "greatest(" + ", ".join(f"coalesce({status_rank(x)}, 0)" for x in s) + ")" if len(s) > 1 \
        else f"coalesce({status_rank(s[0])}, 0)"
    return f"(CASE {r} WHEN 2 THEN 'Replace' WHEN 1 THEN 'Monitor' ELSE 'Good' END)"


def repair_count_bin(n: str) -> str:
    return (f"(CASE WHEN {n} <= 1 THEN '1 repair' WHEN {n} = 2 THEN '2 repairs' "
            f"WHEN {n} = 3 THEN '3 repairs' WHEN {n} = 4 THEN '4 repairs' ELSE '5+ repairs' END)")


def abbreviate_building(x: str) -> str:
    n = normalize_building(x)
    words = (f"list_filter(regexp_split_to_array({n}, '[\\s\\-/]+'), "
             f"lambda w: w <> '' AND lower(w) NOT IN ('the', 'of', 'and', 'a'))")
    alnum = f"regexp_replace({n}, '[^A-Za-z0-9]', '', 'g')"
    initials = f"substr(array_to_string(list_transform({words}[1:3], lambda w: upper(substr(w, 1, 1))), ''), 1, 3)"
    table = "CASE " + n + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in BUILDING_ABBREV.items()) + " END"
    fallback = (f"CASE WHEN length({alnum}) BETWEEN 1 AND 3 THEN upper({alnum}) "
                f"WHEN len({words}) = 0 THEN upper(substr({n}, 1, 3)) "
                f"WHEN len({words}) >= 2 THEN {initials} "
                f"ELSE upper(substr({words}[1], 1, 3)) END")
    return f"(CASE WHEN {n} = '' THEN '' ELSE coalesce({table}, {fallback}) END)"


def month_key(d: str) -> str:
    return f"strftime({d}, '%Y-%m')"


# Repair rows of the benchmark binding (see upkeep.sources.bench).
REPAIRS_CTE = """
r AS (
  SELECT l_partkey AS equip_id, l_suppkey AS suppkey,
         CAST(l_shipdate AS DATE) AS date, strftime(l_shipdate, '%Y-%m') AS month_key,
         l_quantity / 10.0::DOUBLE AS hours,
         round_even(l_quantity / 10.0::DOUBLE * 12.5::DOUBLE, 2) AS labor,
         l_extendedprice * l_discount / 1000.0::DOUBLE AS parts,
         {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_suppkey, 'e': l_extendedprice} AS row_ord
  FROM lineitem),
loc AS (
  SELECT s_suppkey, n_name AS location FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)
"""

SERVICE_CTE = """
s AS (
  SELECT l_partkey AS equip_id, l_suppkey AS suppkey, CAST(o_orderdate AS DATE) AS sched_date,
         CASE WHEN l_linestatus = 'F' AND l_shipdate >= o_orderdate THEN CAST(l_shipdate AS DATE) END AS completed_date,
         CASE WHEN l_linestatus = 'F' THEN 'Completed' ELSE 'Scheduled' END AS status,
         o_orderpriority AS description, strftime(o_orderdate, '%Y-%m') AS month_key,
         {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey, 'e': l_suppkey, 'f': l_extendedprice} AS row_ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def norm_desc(x: str) -> str:
    s = f"lower({strip_ws(f'coalesce(CAST({x} AS VARCHAR), {EMPTY})')})"
    s = f"regexp_replace({s}, '(?i)\\s*-\\s*\\(repair\\)\\s*$', '')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    return f"substr({s}, 1, 80)"


def soft_norm_desc(x: str) -> str:
    s = f"regexp_replace({norm_desc(x)}, '\\b(rig|closet|room|bldg|building)\\b', ' ', 'g')"
    t = strip_ws(f"regexp_replace({s}, '\\s+', ' ', 'g')")
    return f"substr({t}, 1, 80)"


def raw_status(x: str) -> str:
    return f"(CASE WHEN lower({strip_ws(f'coalesce({x}, {EMPTY})')}) = 'completed' THEN 'Completed' ELSE 'Scheduled' END)"


def business_calendar_cte(start: str = "1990-01-01", end: str = "2040-12-31",
                          hol_start: str = "2000-01-01", hol_end: str = "2035-12-31") -> str:
    """cal(cal_date, is_bd, cum_bd) with US federal holidays (observed) in range."""
    def obs(m, d):
        return (f"((month(x) = {m} AND day(x) = {d} AND isodow(x) <= 5) OR "
                f"(isodow(x) = 5 AND month(x + 1) = {m} AND day(x + 1) = {d}) OR "
                f"(isodow(x) = 1 AND month(x - 1) = {m} AND day(x - 1) = {d}))")
    parts = [obs(1, 1), obs(7, 4), obs(11, 11), obs(12, 25), f"({obs(6, 19)} AND x >= DATE '2021-06-18')"]
    for m, dow, first in ((1, 1, 15), (2, 1, 15), (5, 1, 25), (9, 1, 1), (10, 1, 8), (11, 4, 22)):
        parts.append(f"(month(x) = {m} AND isodow(x) = {dow} AND day(x) BETWEEN {first} AND {first + 6})")
    hol = f"(({' OR '.join(parts)}) AND x BETWEEN DATE '{hol_start}' AND DATE '{hol_end}')"
    return f"""
days AS (SELECT CAST(generate_series AS DATE) AS x FROM generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)),
cal0 AS (SELECT x AS cal_date, CASE WHEN isodow(x) <= 5 AND NOT {hol} THEN 1 ELSE 0 END AS is_bd FROM days),
cal AS (SELECT cal_date, is_bd, sum(is_bd) OVER (ORDER BY cal_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_bd FROM cal0)
"""


def business_days(a: str, b: str, ca: str, cb: str) -> str:
    """Span expression given calendar aliases joined on a and b."""
    return (f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR {b} < {a} THEN NULL WHEN {a} = {b} THEN 1.0 "
            f"ELSE CAST({cb}.cum_bd - {ca}.cum_bd + {ca}.is_bd AS DOUBLE) END)")


def _case_map(x: str, d: dict, default: str | None = None) -> str:
    body = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in d.items())
    return f"(CASE {x} {body} ELSE {default if default is not None else 'NULL'} END)"


def keyword_ctes(src: str, name_col: str) -> str:
    """CTEs ending in ``kw(name, keyword, label, equip_type)`` for distinct names of ``src``."""
    from upkeep.functions import keywords as K
    norm0 = (f"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({name_col}, ''))), "
             f"'[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))")
    clean = (f"trim(regexp_replace(trim(regexp_replace({norm0}, '(?i)\\s*#\\s*\\d+\\s*$|\\s+number\\s+\\d+\\s*$', '')), "
             f"'\\s+', ' ', 'g'))")
    canon = _case_map(f"coalesce({_case_map('t', K.TOKEN_TYPO)}, t)", K.BRAND_ALIASES,
                      f"coalesce({_case_map('t', K.TOKEN_TYPO)}, t)")
    slugs = ", ".join(q(s) for s in K.BRAND_SLUGS)
    cat = "(CASE " + " ".join(f"WHEN regexp_matches(n, {q(p)}) THEN {q(s)}" for p, s in K.CATEGORY_RULES) + " END)"
    ladder = ("coalesce(nullif(regexp_extract(n, '\\bladder\\s+(\\d+)\\b', 1), '') || 'ft', "
              "nullif(regexp_extract(n, '\\b(\\d+)\\s*(?:ft|foot|feet)\\b', 1), '') || 'ft')")
    scrub = ("(CASE WHEN regexp_matches(n, '\\bi\\s*18\\b|i18b|i18c') THEN '18' "
             "WHEN regexp_matches(n, '\\bi\\s*20\\b|i20') THEN '20' END)")
    generic = f"nullif(regexp_extract(n, {q(K.SIZE_PATTERN)}, 1), '')"
    sized = ", ".join(q(c) for c in K.SIZED_CATEGORIES)
    label_cat = f"coalesce({_case_map('kc', K.CATEGORY_LABEL)}, kc)"
    label_brand = f"coalesce({_case_map('kb', K.BRAND_LABEL)}, upper(substr(kb, 1, 1)) || substr(kb, 2))"
    coarse = []
    for words, label in K.NAME_CLASS_RULES:
        cond = " OR ".join(f"contains(lt, {q(w)})" for w in words)
        coarse.append(f"WHEN {cond} THEN {q(label)}")
    coarse_sql = ("(CASE WHEN lt = '' THEN 'Other' " + " ".join(coarse) +
                  " WHEN contains(lt, 'vacuum') OR suffix(lt, ' vac') OR contains(lt, ' vac ') THEN 'Other vacuums' "
                  "WHEN contains(lt, 'cart') OR contains(lt, 'janitor') OR contains(lt, 'mop bucket') "
                  "OR contains(lt, 'mop ') OR contains(lt, 'wringer') THEN 'Janitorial / carts' ELSE 'Other' END)")
    return f"""
kw0 AS (SELECT DISTINCT {name_col} AS name FROM {src}),
kw1 AS (SELECT name, {clean.replace(name_col, 'name')} AS n,
               lower(trim(coalesce(name, ''))) AS lt FROM kw0),
kw2 AS (SELECT *, CASE WHEN list_contains(string_split(n, ' '), 'pro') AND list_contains(string_split(n, ' '), 'team')
                       THEN 'proteam'
                       ELSE list_filter(list_transform(string_split(n, ' '), lambda t: {canon}),
                                        lambda c: c IN ({slugs}))[1] END AS kb,
               {cat} AS kc0 FROM kw1),
kw3 AS (SELECT *, CASE WHEN kc0 = 'ladder' THEN {ladder}
                       WHEN kc0 = 'scrubber' THEN coalesce({scrub}, {generic})
                       WHEN kc0 IN ({sized}) THEN {generic} END AS ks,
               coalesce(kc0, {_case_map('kb', K.DEFAULT_BRAND_CATEGORY)}) AS kc FROM kw2),
kw4 AS (SELECT *, CASE WHEN n = '' OR regexp_matches(n, {q(K.JUNK_PATTERN)}) OR kc IS NULL
                            OR (kc = 'ladder' AND ks IS NULL) THEN NULL
                       ELSE concat_ws('|', kc, kb, ks) END AS keyword FROM kw3),
kw AS (SELECT name, keyword,
              CASE WHEN keyword IS NULL THEN NULL
                   WHEN kc = 'ladder' AND ks IS NOT NULL THEN replace(ks, 'ft', '') || ''' Ladder'
                   WHEN kb IS NOT NULL AND ks IS NOT NULL AND NOT suffix(ks, 'ft')
                        THEN {label_brand} || ' ' || ks || '" ' || {label_cat}
                   WHEN kb IS NOT NULL THEN {label_brand} || ' ' || {label_cat}
                   WHEN ks IS NOT NULL AND NOT suffix(ks, 'ft') THEN ks || '" ' || {label_cat}
                   WHEN ks IS NOT NULL THEN replace(ks, 'ft', '') || ''' ' || {label_cat}
                   ELSE {label_cat} END AS label,
              CASE WHEN name IS NULL OR trim(name) = '' THEN NULL
                   ELSE coalesce({_case_map("CASE WHEN keyword IS NULL THEN NULL ELSE kc END", K.KEYWORD_TO_EQUIP_TYPE)},
                                 {_case_map(coarse_sql, K.NAME_CLASS_TO_EQUIP_TYPE)}) END AS equip_type
       FROM kw4)"""


def equipment_names_cte() -> str:
    from upkeep.sources.bench import KIND_BY_NOUN, MAKER_BY_ADJECTIVE
    maker = _case_map("split_part(p_name, ' ', 1)", MAKER_BY_ADJECTIVE, "''")
    kind = _case_map("split_part(p_name, ' ', -1)", KIND_BY_NOUN, "''")
    return f"""
en AS (SELECT p_partkey AS equip_id, regexp_replace(trim(concat_ws(' ', {maker}, {kind}, CAST(p_size AS VARCHAR))),
                                                    '  +', ' ', 'g') AS equip_name,
              p_retailprice AS cost FROM part)"""


def catalog_ctes() -> str:
    """cm(model, norm_name, category, ord, tokens) and cp(model, year, price) for the bench catalog."""
    from upkeep.operators.catalog_match import BRAND_TOKENS, CATALOG_STOPWORDS
    from upkeep.sources.bench import KIND_BY_NOUN, MAKER_BY_ADJECTIVE
    maker = _case_map("split_part(p_name, ' ', 1)", MAKER_BY_ADJECTIVE, "''")
    kind = _case_map("split_part(p_name, ' ', -1)", KIND_BY_NOUN, "''")
    size = "CAST(p_size AS VARCHAR)"
    model = (f"regexp_replace(trim(CASE WHEN split_part(p_name, ' ', -1) = 'anvil' "
             f"THEN concat_ws(' ', {maker}, 'i' || {size}, 'walk-behind scrubber') "
             f"ELSE concat_ws(' ', {maker}, {kind}, {size}) END), '  +', ' ', 'g')")
    cat = (f"CASE WHEN split_part(p_name, ' ', -1) = 'anvil' THEN 'Walk-Behind Scrubber' "
           f"ELSE array_to_string(list_transform(string_split({kind}, ' '), "
           f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') END")
    stops = ", ".join(q(s) for s in CATALOG_STOPWORDS)
    brands = ", ".join(q(s) for s in BRAND_TOKENS)
    norm = ("trim(regexp_replace(regexp_replace(lower(strip_accents(model)), '[^\\w\\s]', ' ', 'g'), "
            "'\\s+', ' ', 'g'))")
    return f"""
cr AS (SELECT {model} AS model, {cat} AS category, year(l_shipdate) AS year, l_extendedprice / l_quantity AS price,
              {{'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_suppkey, 'e': l_extendedprice}} AS ord
       FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND p_size <= 30),
cm0 AS (SELECT model, arg_min(category, ord) AS category, min(ord) AS ord FROM cr GROUP BY model),
cm AS (SELECT *, {norm} AS norm_name,
              list_filter(list_distinct(list_filter(string_split({norm}, ' '), lambda t: t <> '' AND t NOT IN ({stops}))),
                          lambda t: regexp_matches(t, '\\d') OR t IN ({brands})) AS tokens FROM cm0),
cp AS (SELECT model, year, arg_max(price, ord) AS price FROM cr GROUP BY model, year)"""


def catalog_match_ctes(names_src: str, name_col: str) -> str:
    """cmatch(name, model, match_tier) over distinct names of ``names_src``."""
    from upkeep.operators.catalog_match import BRAND_TOKENS, CATALOG_STOPWORDS
    stops = ", ".join(q(s) for s in CATALOG_STOPWORDS)
    brands = ", ".join(q(s) for s in BRAND_TOKENS)
    clean = ("trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(strip_accents("
             f"coalesce({name_col}, ''))), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), "
             "'(?i)\\s*#\\s*\\d+\\s*$|\\s+number\\s+\\d+\\s*$', '')), '\\s+', ' ', 'g'))")
    return f"""
nm AS (SELECT DISTINCT {name_col} AS name, {clean} AS n FROM {names_src}),
nn AS (SELECT DISTINCT n, list_filter(list_distinct(list_filter(string_split(n, ' '), lambda t: t <> '' AND t NOT IN ({stops}))),
                                      lambda t: regexp_matches(t, '\\d') OR t IN ({brands})) AS ntok
       FROM nm WHERE n <> ''),
c1 AS (SELECT nn.n, cm.model, 1 AS tier,
              CASE WHEN contains(nn.n, 'versamatic') AND contains(cm.norm_name, 'versamatic') THEN 0
                   WHEN contains(nn.n, 'kaivac') AND contains(cm.norm_name, 'kaivac') THEN 10
                   WHEN regexp_matches(nn.n, '\\bpuzzi\\b|\\bpriza\\b') AND contains(cm.norm_name, 'puzzi') THEN 20
                   WHEN contains(nn.n, 'chariot') AND contains(cm.norm_name, 'chariot') THEN
                        CASE WHEN (contains(nn.n, 'iscrub') AND contains(cm.norm_name, 'iscrub'))
                                  OR (contains(nn.n, 'ivac') AND contains(cm.norm_name, 'ivac')) THEN 30 ELSE 31 END
              END AS sub, 0 AS score, cm.ord
       FROM nn, cm),
c2 AS (SELECT nn.n, cm.model, 2 AS tier, 0 AS sub,
              abs(CAST(regexp_extract(cm.norm_name, '\\bice i(\\d+)\\b', 1) AS INTEGER)
                  - CAST(regexp_extract(nn.n, '\\b(1[3-9]|2[0-9]|3[0-2])\\b', 1) AS INTEGER)) AS score, cm.ord
       FROM nn, cm
       WHERE regexp_matches(nn.n, '\\bice\\b') AND regexp_matches(nn.n, '\\b(1[3-9]|2[0-9]|3[0-2])\\b')
         AND contains(lower(cm.category), 'walk-behind scrubber') AND regexp_matches(cm.norm_name, '\\bice i(\\d+)\\b')),
c3 AS (SELECT nn.n, cm.model, 3 AS tier, 0 AS sub, -length(cm.norm_name) AS score, cm.ord FROM nn, cm
       WHERE length(cm.norm_name) >= 8 AND (contains(nn.n, cm.norm_name) OR contains(cm.norm_name, nn.n))),
c4a AS (SELECT nn.n, cm.model, cm.norm_name, cm.ord, cm.tokens, list_intersect(nn.ntok, cm.tokens) AS ov
        FROM nn, cm WHERE len(cm.tokens) > 0),
c4 AS (SELECT n, model, 4 AS tier, 0 AS sub,
              -CAST(len(ov) / len(tokens) * 1000000 AS BIGINT) * 1000 - length(norm_name) AS score, ord
       FROM c4a
       WHERE len(ov) > 0 AND len(list_filter(ov, lambda t: NOT regexp_full_match(t, '\\d+[a-z]*'))) > 0
         AND (len(list_filter(tokens, lambda t: regexp_matches(t, '\\d'))) = 0
              OR len(list_intersect(ov, list_filter(tokens, lambda t: regexp_matches(t, '\\d')))) > 0)
         AND len(ov) / len(tokens) >= 0.5),
call AS (SELECT * FROM c1 WHERE sub IS NOT NULL UNION ALL SELECT * FROM c2 WHERE score <= 2
         UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4),
cbest AS (SELECT n, model, tier FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY tier, sub, score, ord) AS rn
                                      FROM call) WHERE rn = 1),
cmatch AS (SELECT nm.name, cbest.model, cbest.tier AS match_tier FROM nm LEFT JOIN cbest ON cbest.n = nm.n)"""
