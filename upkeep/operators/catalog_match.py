"""Map equipment names to catalog models (year-indexed price list).

Tiers, first tier with a hit wins:
1. families: a name mentioning versamatic / kaivac / puzzi|priza / chariot takes
   the first catalog model of that family (chariot: a model sharing iscrub/ivac
   with the name first);
2. size band: an ICE name with a 13-32 size takes the walk-behind scrubber model
   ``ice i<size>`` nearest in size, within 2;
3. containment: a catalog name (>= 8 chars) contained in the name, or the name
   contained in it; longest catalog name wins;
4. token overlap: distinctive tokens (digits or brand words, minus stop words);
   |overlap| / |model tokens| >= 0.5, overlap needs a non-number token and, when
   the model has digit tokens, one of them; best score, then longer name.
Ties go to the earlier catalog model.

No tier pairs every name with every model, and models that a tier cannot tell
apart are reduced to the one that wins before names meet them: the first of a
family and kind, the first of a size, the first of a normalised name, the longest
of a token set. Names meet them by equi joins: the family; the size shifted by
-2..2; for containment one anchor, the rarest ``WINDOW``-character window of the
contained string, against the windows of the other side, verified on the whole
strings; (word token, digit token) pairs between distinct token sets. Candidate
rows grow with the length of the texts, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.functions.keywords import BRAND_ALIASES, BRAND_SLUGS, clean_name
from upkeep.functions.text import norm_equipment_name
from upkeep.session import materialize

# ---- fixed values: catalog stop words -------------------------------------------
CATALOG_STOPWORDS = (
    "auto", "scrubber", "commercial", "upright", "vacuum", "vac", "machine", "floor", "walk",
    "behind", "ride", "on", "stand", "spot", "large", "carpet", "extractor", "head", "detail",
    "self", "contained", "portable", "truck", "mount", "battery", "powered", "corded", "backpack",
    "backpacks", "heated", "maintainer", "restroom", "touch", "no", "wet", "dry", "micro",
    "orbital", "propane", "spray", "rotary", "fuel", "inch", "mini", "team", "pro", "chem", "nb",
    "btl", "nbtl", "atv", "xl", "cleaning", "agitator", "burnisher", "buffer", "extract",
    "upholstery", "the", "and", "with", "hp", "mx3", "brs", "in", "m18", "0895", "versatile",
    "prochem", "hydro", "force", "nautilus", "square", "doodle", "wrangler", "stallion",
    "thoroughbred", "rally", "rev3", "rx20", "shovelnose", "micromatic", "iscrub", "ivac", "imop",
    "kleenrite", "mac", "pzu",
)
MIN_CONTAIN_LEN = 8
ICE_SIZE_PATTERN = r"\b(1[3-9]|2[0-9]|3[0-2])\b"
# ----------------------------------------------------------------------------------

WINDOW = 8  # characters of the windows that containment is anchored on; at most MIN_CONTAIN_LEN

BRAND_TOKENS = tuple(sorted(set(BRAND_ALIASES) | set(BRAND_SLUGS)))


def distinctive_tokens(norm: Column) -> Column:
    toks = F.array_distinct(F.filter(F.split(norm, " "), lambda t: (t != "") & ~t.isin(*CATALOG_STOPWORDS)))
    return F.filter(toks, lambda t: t.rlike(r"\d") | t.isin(*BRAND_TOKENS))


def load_catalog(raw: DataFrame, order_col: str = "row_ord") -> tuple[DataFrame, DataFrame]:
    """Catalog rows (model, category, year, price, row_ord) with valid year and
    positive price -> (models: model, norm_name, category, ord, tokens;
    prices: model, year, price). Category = first row of the model, price per
    (model, year) = last row. The rows are read and their prices parsed once: the
    first and last row of each (model, year) text are written, and both tables
    follow from them."""
    from upkeep.functions import parse_dollar_amount, parse_purchase_year
    rows = raw.select("model", "year", "category", parse_dollar_amount("price").alias("price"), F.col(order_col).alias("_o"))
    valid = F.col("price").isNotNull()
    ends = materialize(rows.groupBy("model", "year").agg(
        F.min(F.when(valid, F.struct("_o", "category"))).alias("first"),
        F.max(F.when(valid, F.struct("_o", "price"))).alias("last")).where(F.col("last").isNotNull()))
    r = ends.select(F.trim(F.col("model").cast("string")).alias("model"),
                    F.trim(F.col("first.category").cast("string")).alias("category"), F.col("first._o").alias("_first"),
                    parse_purchase_year("year").alias("year"), F.col("last.price").alias("price"), F.col("last._o").alias("_last")) \
            .where((F.col("model") != "") & F.col("year").isNotNull())
    models = r.groupBy("model").agg(F.min_by("category", "_first").alias("category"), F.min("_first").alias("ord"))
    models = models.withColumn("norm_name", norm_equipment_name("model")).where(F.col("norm_name") != "") \
                   .withColumn("tokens", distinctive_tokens(F.col("norm_name")))
    prices = r.groupBy("model", "year").agg(F.max_by("price", "_last").alias("price"))
    return models, prices


def _score(cost: Column, length: Column) -> Column:
    """Rank of a candidate inside its tier: lower cost first, then the longer name."""
    return F.struct(cost.cast("double").alias("cost"), (-length).alias("short")).alias("score")


def _windows(s: Column, width: int) -> Column:
    """The distinct ``width``-character windows of ``s`` (at least that long)."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - width + 1), lambda i: F.substring(s, i, width)))


def _short_substrings(s: Column) -> Column:
    """The distinct substrings of ``s`` shorter than ``WINDOW``."""
    return F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.least(F.length(s), F.lit(WINDOW - 1))),
        lambda n: F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, n)))))


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) for every string of ``inner`` (distinct, ``WINDOW`` characters
    or more) that occurs in a string of ``outer`` (distinct). An inner string with
    a window that no outer string has is dropped; the others meet only the outer
    strings that hold their rarest window."""
    ow = outer.where(F.length("outer") >= WINDOW).select("outer", F.explode(_windows(F.col("outer"), WINDOW)).alias("w"))
    often = ow.groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    iw = inner.where(F.length("inner") >= WINDOW).withColumn("ws", _windows(F.col("inner"), WINDOW)) \
              .select("inner", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    anchor = iw.join(often, "w").groupBy("inner", "n").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("f", "w")).alias("a")) \
               .where(F.col("hits") == F.col("n")).select("inner", F.col("a.w").alias("w"))
    return anchor.join(ow, "w").where(F.contains("outer", F.col("inner"))).select("inner", "outer")


def _contains_candidates(names: DataFrame, models: DataFrame) -> DataFrame:
    """Best of the models (catalog name >= 8 chars) that a name holds or that hold
    the name; of equal catalog names the first model stands for all."""
    m = models.where(F.length("norm_name") >= MIN_CONTAIN_LEN) \
              .groupBy("norm_name").agg(F.min(F.struct("ord", "model")).alias("m"))
    held = _contained(m.select(F.col("norm_name").alias("inner")), names.select(F.col("name_norm").alias("outer"))) \
        .select(F.col("outer").alias("name_norm"), F.col("inner").alias("norm_name"))
    holds = _contained(names.select(F.col("name_norm").alias("inner")), m.select(F.col("norm_name").alias("outer"))) \
        .select(F.col("inner").alias("name_norm"), F.col("outer").alias("norm_name"))
    rank = F.struct((-F.length("norm_name")).alias("short"), F.col("m.ord").alias("ord"), F.col("m.model").alias("model"))
    long_names = held.unionByName(holds).join(m, "norm_name").select("name_norm", rank.alias("r"))
    # names shorter than a window: the best model of every short substring
    short = m.select(F.explode(_short_substrings(F.col("norm_name"))).alias("name_norm"), rank.alias("r")) \
             .groupBy("name_norm").agg(F.min("r").alias("r"))
    short_names = names.where(F.length("name_norm") < WINDOW).select("name_norm").join(short, "name_norm")
    return long_names.unionByName(short_names).select(
        "name_norm", F.col("r.model").alias("model"), F.lit(3).alias("tier"), F.lit(0).alias("sub"),
        _score(F.lit(0), -F.col("r.short")), F.col("r.ord").alias("ord"))


def _token_keys(toks: Column, has_digit_side: Column | None = None) -> Column:
    """Join keys a valid token match must share: (word token, digit token) pairs,
    plus (word token, '') for models without digit tokens. A word token is one
    not of the form ``\\d+[a-z]*``; a digit token contains a digit."""
    words = F.filter(toks, lambda t: ~t.rlike(r"^\d+[a-z]*$"))
    digits = F.filter(toks, lambda t: t.rlike(r"\d"))
    pairs = F.flatten(F.transform(words, lambda w: F.transform(digits, lambda d: F.struct(w.alias("w"), d.alias("d")))))
    singles = F.transform(words, lambda w: F.struct(w.alias("w"), F.lit("").alias("d")))
    if has_digit_side is None:  # names: both kinds of keys
        return F.concat(pairs, singles)
    return F.when(F.size(digits) > 0, pairs).otherwise(singles)  # models: the kind their rule needs


def _token_candidates(names: DataFrame, models: DataFrame) -> DataFrame:
    """Token-overlap tier, worked out between distinct token sets: a set of name
    tokens meets a set of model tokens on a shared word token and, when the models
    have digit tokens, a digit token too. Of models with equal sets the longest,
    then first, stands for all."""
    n = names.select("name_norm", F.sort_array(distinctive_tokens(F.col("name_norm"))).alias("ntok")).where(F.size("ntok") > 0)
    nk = n.select("ntok").distinct().select("ntok", F.explode(_token_keys(F.col("ntok"))).alias("k"))
    m = models.where(F.size("tokens") > 0).groupBy(F.sort_array("tokens").alias("tokens")).agg(
        F.min(F.struct((-F.length("norm_name")).alias("short"), "ord", "model")).alias("m"))
    mk = m.select("m", "tokens", F.explode(_token_keys(F.col("tokens"), F.lit(True))).alias("k"))
    share = F.size(F.array_intersect("ntok", "tokens")) / F.size("tokens")
    best = nk.join(mk, "k").withColumn("share", share).where(F.col("share") >= 0.5).groupBy("ntok").agg(
        F.min(F.struct((-F.col("share")).alias("cost"), F.col("m.short").alias("short"), F.col("m.ord").alias("ord"),
                       F.col("m.model").alias("model"))).alias("b"))
    return n.join(best, "ntok").select(
        "name_norm", F.col("b.model").alias("model"), F.lit(4).alias("tier"), F.lit(0).alias("sub"),
        _score(F.col("b.cost"), -F.col("b.short")), F.col("b.ord").alias("ord"))


def _family_candidates(names: DataFrame, models: DataFrame) -> DataFrame:
    fam = [("versamatic", F.contains(F.col("name_norm"), F.lit("versamatic")), "versamatic"),
           ("kaivac", F.contains(F.col("name_norm"), F.lit("kaivac")), "kaivac"),
           ("puzzi", F.col("name_norm").rlike(r"\bpuzzi\b|\bpriza\b"), "puzzi"),
           ("chariot", F.contains(F.col("name_norm"), F.lit("chariot")), "chariot")]

    def kinds(c):
        return [F.contains(c, F.lit(w)).alias(f"{c}_{w}") for w in ("iscrub", "ivac")]

    keys = F.filter(F.array(*[F.when(cond, F.lit(k)) for k, cond, _ in fam]), lambda x: x.isNotNull())
    nk = names.select("name_norm", F.explode(keys).alias("fam"), *kinds("name_norm"))
    # the first model of each family and kind: sixteen rows at most
    mk = models.select("model", "ord", F.explode(F.filter(
        F.array(*[F.when(F.contains(F.col("norm_name"), F.lit(w)), F.lit(k)) for k, _, w in fam]),
        lambda x: x.isNotNull())).alias("fam"), *kinds("norm_name")) \
        .groupBy("fam", "norm_name_iscrub", "norm_name_ivac").agg(F.min(F.struct("ord", "model")).alias("m"))
    j = nk.join(mk, "fam")
    rank = {k: i for i, (k, _, _) in enumerate(fam)}
    fam_rank = F.coalesce(*[F.when(F.col("fam") == k, F.lit(i)) for k, i in rank.items()])
    alike = (F.col("name_norm_iscrub") & F.col("norm_name_iscrub")) | (F.col("name_norm_ivac") & F.col("norm_name_ivac"))
    sub = F.when((F.col("fam") == "chariot") & ~alike, F.lit(1)).otherwise(F.lit(0))
    return j.select("name_norm", F.col("m.model").alias("model"), F.lit(1).alias("tier"), (fam_rank * 10 + sub).alias("sub"),
                    _score(F.lit(0), F.lit(0)), F.col("m.ord").alias("ord"))


def _ice_candidates(names: DataFrame, models: DataFrame) -> DataFrame:
    n = names.where(F.col("name_norm").rlike(r"\bice\b") & F.col("name_norm").rlike(ICE_SIZE_PATTERN)) \
             .select("name_norm", F.regexp_extract("name_norm", ICE_SIZE_PATTERN, 1).try_cast("int").alias("target"))
    m = models.where(F.contains(F.lower("category"), F.lit("walk-behind scrubber")) &
                     F.col("norm_name").rlike(r"\bice i(\d+)\b")) \
              .select("model", "ord", F.regexp_extract("norm_name", r"\bice i(\d+)\b", 1).try_cast("int").alias("msize")) \
              .where(F.col("msize").between(11, 34)).groupBy("msize").agg(F.min(F.struct("ord", "model")).alias("m"))
    # band join as an equi join: each model size stands for targets msize-2 .. msize+2
    m = m.select("*", F.explode(F.sequence(F.col("msize") - 2, F.col("msize") + 2)).alias("target"))
    j = n.join(m, "target")
    return j.select("name_norm", F.col("m.model").alias("model"), F.lit(2).alias("tier"), F.lit(0).alias("sub"),
                    _score(F.abs(F.col("msize") - F.col("target")), F.lit(0)), F.col("m.ord").alias("ord"))


def match_catalog(names: DataFrame, name_col: str, models: DataFrame) -> DataFrame:
    """(name_col, model, match_tier) for each distinct name; null model when no tier hits."""
    # names are cleaned once each: filters and joins on the cleaned name would otherwise move
    # below the distinct, where every row's name is cleaned
    d = materialize(names.select(name_col).distinct().withColumn("name_norm", clean_name(name_col)))
    # both sides are read by every tier: written once
    nn = materialize(d.select("name_norm").where(F.col("name_norm") != "").distinct())
    models = materialize(models)
    cands = _family_candidates(nn, models).unionByName(_ice_candidates(nn, models)) \
        .unionByName(_contains_candidates(nn, models)).unionByName(_token_candidates(nn, models))
    best = cands.groupBy("name_norm").agg(F.min(F.struct("tier", "sub", "score", "ord", "model")).alias("b"))
    return d.join(best, "name_norm", "left").select(name_col, F.col("b.model").alias("model"),
                                                   F.col("b.tier").alias("match_tier"))


def match_keys(names: DataFrame, name_col: str, keys: DataFrame, key_col: str = "key",
               order_col: str = "key_ord") -> DataFrame:
    """Fuzzy keyword-key match for normalised names: a key contained in the name
    (or the name in the key), longest first; else the key whose tokens (2+
    characters, counted with repeats) occur in the name for at least half of
    them, best share then longer key. Ties go to the earlier key.

    Containment uses anchors (``_contained``) and, for strings shorter than a
    window, their short substrings. In the token tier a key with ``n`` tokens needs
    half of them in the name, so one of its ``n - ceil(n / 2) + 1`` rarest must be
    there: only those are join keys, and the share is then counted on the name."""
    n = materialize(names.select(F.col(name_col).alias("_name")).where(F.col("_name").isNotNull() & (F.col("_name") != ""))
                    .distinct())
    k = materialize(keys.where(F.col(key_col) != "").groupBy(F.col(key_col).alias("_key")).agg(F.min(order_col).alias("_ko")))
    rank = F.struct((-F.length("_key")).alias("l"), F.col("_ko").alias("o"), F.col("_key").alias("_key"))
    outer_names, outer_keys = n.select(F.col("_name").alias("outer")), k.select(F.col("_key").alias("outer"))
    subs = n.select("_name", F.explode(_short_substrings(F.col("_name"))).alias("_sub"))

    def holding(parts: DataFrame, part: str) -> DataFrame:
        """(name, part) for the distinct ``parts`` that occur in a name."""
        long = _contained(parts.select(F.col(part).alias("inner")), outer_names)
        return long.select(F.col("outer").alias("_name"), F.col("inner").alias(part)).unionByName(
            subs.join(parts.select(part), F.col("_sub") == F.col(part)).select("_name", part))

    held = holding(k, "_key").join(k, "_key").select("_name", rank.alias("r"))
    holds = _contained(n.select(F.col("_name").alias("inner")), outer_keys) \
        .select(F.col("inner").alias("_name"), F.col("outer").alias("_key")).join(k, "_key").select("_name", rank.alias("r"))
    of_short = k.select(F.explode(_short_substrings(F.col("_key"))).alias("_name"), rank.alias("r")) \
                .groupBy("_name").agg(F.min("r").alias("r"))
    short = n.where(F.length("_name") < WINDOW).join(of_short, "_name").select("_name", "r")
    sub = held.unionByName(holds).unionByName(short).groupBy("_name").agg(F.min("r").alias("r")) \
              .select("_name", F.col("r._key").alias("_sub_key"))

    toks = k.select("_key", "_ko", F.filter(F.split("_key", " "), lambda t: F.length(t) >= 2).alias("_toks")) \
            .where(F.size("_toks") > 0)
    each = toks.select("_key", F.explode("_toks").alias("_tok"))
    hits = materialize(holding(each.select("_tok").distinct(), "_tok"))
    often = hits.groupBy("_tok").agg(F.count(F.lit(1)).alias("_f"))
    rare = each.join(often, "_tok", "left").groupBy("_key").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("_tok").alias("t")))).alias("_by"))
    size = F.size("_by")
    rare = rare.select("_key", F.explode(F.array_distinct(F.transform(
        F.slice("_by", F.lit(1), size - F.ceil(size * TOKEN_MIN_SCORE).cast("int") + 1), lambda x: x["t"]))).alias("_tok"))
    pairs = hits.join(rare, "_tok").select("_name", "_key").distinct().join(toks, "_key")
    score = F.size(F.filter("_toks", lambda t: F.contains(F.col("_name"), t))) / F.size("_toks")
    tok = pairs.withColumn("_score", score).where(F.col("_score") >= TOKEN_MIN_SCORE).groupBy("_name").agg(
        F.min(F.struct((-F.col("_score")).alias("s"), rank.alias("r"))).alias("b")) \
        .select("_name", F.col("b.r._key").alias("_tok_key"))
    out = n.join(sub, "_name", "left").join(tok, "_name", "left")
    return out.select(F.col("_name").alias(name_col), F.coalesce("_sub_key", "_tok_key").alias(key_col))


# fixed value: minimum token share for the token tier
TOKEN_MIN_SCORE = 0.5
