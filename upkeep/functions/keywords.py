"""Equipment keyword classification: category, brand and size from a free-text
name, combined into a key such as ``scrubber|ice|18``.

The rule tables below are data; the classifier compiles them into one Spark
expression (regex tests and map lookups, all JVM-side). Callers run it on the
*distinct* names of a table and join the keys back, so the cost grows with
the vocabulary, not the row count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from upkeep.functions._col import col
from upkeep.functions.text import norm_equipment_name, strip_ws

# ---- fixed values (reference rule tables) ------------------------------------
# Ordered category rules: the first pattern found in the normalised name wins.
CATEGORY_RULES = (
    (r"\b(back\s*pak|bac\s*pak|backpack|back\s*pack)\b", "backpack"),
    (r"\b(auto[\s-]?scrub|scrubber|i[\s-]?scrubber|orbital)\b", "scrubber"),
    (r"\bburnish", "burnisher"),
    (r"\bbuffer\b", "buffer"),
    (r"\b(carpet\s*fan|air\s*mover|air\s*blower|airblower|carpet\s*blower)\b", "carpet_fan"),
    (r"\b(carpet\s*extract|extractor)\b", "extractor"),
    (r"\bcarpet\s*clean(ing)?\b", "carpet_cleaning"),
    (r"\b(dispenser|chemical\s*disp)\b", "chemical_dispenser"),
    (r"\b(battery[\s-]?powered|cordless)\b", "battery_vacuum"),
    (r"\b(upholstery|puzzi|priza|minni[\s-]?capsol|i[\s-]?capsol)\b", "upholstery"),
    (r"\bchariot\b", "chariot"),
    (r"\bkaivac\b", "kaivac"),
    (r"\bsweeper\b", "sweeper"),
    (r"\bladder\b", "ladder"),
    (r"\bswing\s*arm\b", "swing_arm"),
    (r"\bagitator\b", "agitator"),
    (r"\b(wet[\s/-]?dry|vacuum|versamatic|tennant|colt|pig)\b", "vacuum"),
)
# Brand word -> canonical brand.
BRAND_ALIASES = {
    "versamatic": "versamatic", "waxie": "waxie", "ice": "ice", "advance": "advance", "nss": "nss",
    "windsor": "windsor", "tennant": "tennant", "karcher": "karcher", "karcker": "karcher",
    "rubbermaid": "rubbermaid", "proteam": "proteam", "pro": "proteam", "team": "proteam",
    "milwaukee": "milwaukee", "viper": "viper", "clarke": "clarke", "lindhaus": "lindhaus",
    "lindhause": "lindhaus", "sandia": "sandia", "powerflite": "powerflite", "duplex": "duplex",
    "everest": "everest", "hydraforce": "hydraforce", "rotovac": "rotovac", "hako": "hako",
    "sterling": "sterling", "ster": "sterling", "pacific": "pacific", "olympian": "olympian",
    "radius": "radius", "champ": "nss", "es4000": "advance", "puzzi": "karcher", "priza": "priza",
    "minuteman": "minuteman",
}
# Misspelt brand words.
TOKEN_TYPO = {"lindhause": "lindhaus", "lindhous": "lindhaus", "tennent": "tennant", "tenent": "tennant",
              "versamaticc": "versamatic", "winser": "windsor"}
CATEGORY_LABEL = {
    "backpack": "Backpack", "scrubber": "Scrubber", "burnisher": "Burnisher", "buffer": "Buffer",
    "carpet_fan": "Carpet Fan", "extractor": "Carpet Extractor", "upholstery": "Upholstery Cleaner",
    "chariot": "Chariot", "kaivac": "Kaivac", "sweeper": "Sweeper", "ladder": "Ladder",
    "agitator": "Agitator", "vacuum": "Vacuum", "chemical_dispenser": "Chemical Dispenser",
    "battery_vacuum": "Battery-powered vacuum", "carpet_cleaning": "Carpet Cleaning", "swing_arm": "Swing Arm",
}
KEYWORD_TO_EQUIP_TYPE = {
    "backpack": "Backpack Vacuum", "scrubber": "Scrubber", "burnisher": "Burnisher", "buffer": "Buffer",
    "carpet_fan": "Floor Fan", "extractor": "Carpet Cleaning Machine", "carpet_cleaning": "Carpet Cleaning",
    "upholstery": "Upholstery Cleaner", "chariot": "Chariot", "kaivac": "Kaivac", "sweeper": "Vacuum",
    "ladder": "Ladder", "agitator": "Agitator", "swing_arm": "Swing Arm", "vacuum": "Vacuum",
    "chemical_dispenser": "Chemical Dispenser", "battery_vacuum": "Battery-powered vacuum",
}
BRAND_LABEL = {"ice": "ICE", "nss": "NSS", "proteam": "ProTeam", "kaivac": "KaiVac", "karcher": "Karcher"}
DEFAULT_BRAND_CATEGORY = {
    "advance": "scrubber", "nss": "scrubber", "ice": "scrubber", "windsor": "scrubber",
    "everest": "scrubber", "duplex": "scrubber", "tennant": "vacuum", "versamatic": "vacuum",
    "clarke": "vacuum", "olympian": "vacuum", "lindhaus": "vacuum", "rubbermaid": "backpack",
    "milwaukee": "backpack", "proteam": "backpack", "waxie": "buffer", "karcher": "carpet_fan",
    "sandia": "carpet_fan", "powerflite": "carpet_fan", "viper": "burnisher", "hako": "buffer",
    "sterling": "buffer", "pacific": "buffer", "rotovac": "extractor", "priza": "upholstery",
    "radius": "sweeper", "minuteman": "buffer",
}
SIZE_PATTERN = r"\b(1[3-9]|2[0-9]|3[0-9]|4[0-9]|5[0-5])\b"
SIZED_CATEGORIES = ("scrubber", "burnisher", "buffer", "chariot", "vacuum")
JUNK_PATTERN = r"\b(storage\s*area|shop\s*vac|trash\s*can|tailvac)\b|^brad\b|\b\d{4,}\b"
STRIP_PATTERN = r"(?i)\s*#\s*\d+\s*$|\s+number\s+\d+\s*$"
# Coarse name classes (ordered substring rules) and their equipment types.
NAME_CLASS_RULES = (
    (("versamatic",), "Versamatic"), (("lindhaus",), "Lindhaus"), (("kaivac",), "Kaivac"),
    (("ladder",), "Ladders"), (("dispenser", "chemical disp"), "Dispensers"),
    (("burnisher", "buffer", "scrubber", "auto scrub", "autoscrub", "floor machine"), "Floor machines"),
    (("extractor", "carpet ", "carpet-", "spotter"), "Carpet / extractors"),
    (("wet-dry", "wet dry", "wet/dry", "wetdry", "shop vac", "shop-vac", "shopvac"), "Wet-dry / shop vacuums"),
    (("viper",), "Wet-dry / shop vacuums"),
)
NAME_CLASS_TO_EQUIP_TYPE = {
    "Versamatic": "Vacuum", "Lindhaus": "Vacuum", "Kaivac": "Kaivac", "Ladders": "Ladder",
    "Dispensers": "Chemical Dispenser", "Floor machines": "Scrubber", "Carpet / extractors": "Carpet Cleaning",
    "Wet-dry / shop vacuums": "Vacuum", "Other vacuums": "Vacuum",
}
# -------------------------------------------------------------------------------

BRAND_SLUGS = tuple(sorted(set(BRAND_ALIASES.values())))


def _map(d: dict) -> Column:
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def clean_name(c) -> Column:
    n = F.regexp_replace(norm_equipment_name(c), STRIP_PATTERN, "")
    return strip_ws(F.regexp_replace(strip_ws(n), r"\s+", " "))


def canonical_brand_token(t: Column) -> Column:
    fixed = F.coalesce(F.element_at(_map(TOKEN_TYPO), t), t)
    return F.coalesce(F.element_at(_map(BRAND_ALIASES), fixed), fixed)


def detect_brand(norm: Column) -> Column:
    tokens = F.split(norm, " ")
    hits = F.filter(F.transform(tokens, canonical_brand_token), lambda s: s.isin(*BRAND_SLUGS))
    pro_team = F.array_contains(tokens, "pro") & F.array_contains(tokens, "team")
    return F.when(pro_team, F.lit("proteam")).otherwise(F.try_element_at(hits, F.lit(1)))


def detect_category(norm: Column) -> Column:
    out = None
    for pattern, slug in CATEGORY_RULES:
        out = (F.when(norm.rlike(pattern), F.lit(slug)) if out is None
               else out.when(norm.rlike(pattern), F.lit(slug)))
    return out


def _first_group(norm: Column, pattern: str, idx: int = 1) -> Column:
    return F.when(norm.rlike(pattern), F.regexp_extract(norm, pattern, idx))


def detect_size(norm: Column, category: Column) -> Column:
    ladder = F.coalesce(F.concat(_first_group(norm, r"\bladder\s+(\d+)\b"), F.lit("ft")),
                        F.concat(_first_group(norm, r"\b(\d+)\s*(?:ft|foot|feet)\b"), F.lit("ft")))
    scrub = (F.when(norm.rlike(r"\bi\s*18\b|i18b|i18c"), F.lit("18"))
             .when(norm.rlike(r"\bi\s*20\b|i20"), F.lit("20")))
    generic = _first_group(norm, SIZE_PATTERN)
    return (F.when(category == "ladder", ladder)
            .when(category == "scrubber", F.coalesce(scrub, generic))
            .when(category.isin(*SIZED_CATEGORIES), generic))


def with_keyword(df, name_col: str, out: str = "keyword"):
    """Add ``out`` = ``category[|brand][|size]`` or null (junk, no category,
    ladder without size). Each step is its own column so the normalised name
    is computed once, not re-expanded inside every rule."""
    d = df.withColumn("_kn", clean_name(name_col))
    d = d.withColumn("_kb", detect_brand(F.col("_kn"))).withColumn("_kc0", detect_category(F.col("_kn")))
    d = d.withColumn("_ks", detect_size(F.col("_kn"), F.col("_kc0")))
    d = d.withColumn("_kc", F.coalesce(F.col("_kc0"), F.element_at(_map(DEFAULT_BRAND_CATEGORY), F.col("_kb"))))
    bad = ((F.col("_kn") == "") | F.col("_kn").rlike(JUNK_PATTERN) | F.col("_kc").isNull() |
           ((F.col("_kc") == "ladder") & F.col("_ks").isNull()))
    d = d.withColumn(out, F.when(~bad, F.concat_ws("|", F.col("_kc"), F.col("_kb"), F.col("_ks"))))
    return d.drop("_kn", "_kb", "_kc0", "_ks", "_kc")


def with_keyword_label(df, key_col: str = "keyword", out: str = "label"):
    d = df.withColumn("_kp", keyword_parts(key_col))
    return d.withColumn(out, keyword_label_from_parts(F.col(key_col), F.col("_kp"))).drop("_kp")


def with_equip_type_from_name(df, name_col: str, out: str = "equip_type"):
    """Keyword rules first, then the coarse name class mapped to an equipment type."""
    d = with_keyword(df, name_col, "_kk")
    blank = F.col(name_col).isNull() | (strip_ws(F.col(name_col).cast("string")) == "")
    kw = equip_type_from_keyword("_kk")
    coarse = F.element_at(_map(NAME_CLASS_TO_EQUIP_TYPE), name_class(name_col))
    return d.withColumn(out, F.when(~blank, F.coalesce(kw, coarse))).drop("_kk")


def keyword_parts(key) -> Column:
    """struct(category, brand, size) of a key."""
    parts = F.split(col(key), r"\|")
    rest = F.slice(parts, 2, 100)
    size = F.try_element_at(F.filter(rest, lambda p: p.rlike(r"^\d+$") | p.endswith("ft")), F.lit(-1))
    brand = F.try_element_at(F.filter(rest, lambda p: ~(p.rlike(r"^\d+$") | p.endswith("ft")) &
                                  (p.isin(*BRAND_SLUGS) | p.isin(*BRAND_ALIASES.keys()))), F.lit(-1))
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("category"), brand.alias("brand"), size.alias("size"))


def keyword_label_from_parts(key: Column, p: Column) -> Column:
    """Display label such as ``ICE 18" Scrubber`` or ``6' Ladder``."""
    cat, brand, size = p["category"], p["brand"], p["size"]
    cat_label = F.coalesce(F.element_at(_map(CATEGORY_LABEL), cat),
                           F.initcap(F.regexp_replace(cat, "_", " ")))
    brand_label = F.coalesce(F.element_at(_map(BRAND_LABEL), brand), F.initcap(brand))
    feet = F.regexp_replace(size, "ft$", "")
    inch = size.isNotNull() & ~size.endswith("ft")
    return (F.when(key.isNull(), F.lit(None))
            .when((cat == "ladder") & size.isNotNull(), F.concat(feet, F.lit("' Ladder")))
            .when(brand_label.isNotNull() & inch, F.concat(brand_label, F.lit(" "), size, F.lit('" '), cat_label))
            .when(brand_label.isNotNull(), F.concat(brand_label, F.lit(" "), cat_label))
            .when(inch, F.concat(size, F.lit('" '), cat_label))
            .when(size.isNotNull(), F.concat(feet, F.lit("' "), cat_label))
            .otherwise(cat_label))


def equip_type_from_keyword(key) -> Column:
    return F.element_at(_map(KEYWORD_TO_EQUIP_TYPE), F.try_element_at(F.split(col(key), r"\|"), F.lit(1)))


def name_class(c) -> Column:
    """Coarse class of a name by ordered substring rules."""
    t = F.lower(strip_ws(F.coalesce(col(c).cast("string"), F.lit(""))))
    out = F.when(t == "", F.lit("Other"))
    for words, label in NAME_CLASS_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(w))
        out = out.when(hit, F.lit(label))
    vac = F.contains(t, F.lit("vacuum")) | t.endswith(" vac") | F.contains(t, F.lit(" vac "))
    jan = F.lit(False)
    for w in ("cart", "janitor", "mop bucket", "mop ", "wringer"):
        jan = jan | F.contains(t, F.lit(w))
    return out.when(vac, F.lit("Other vacuums")).when(jan, F.lit("Janitorial / carts")).otherwise(F.lit("Other"))


def keyword_dimension(df, name_col: str):
    """(name, keyword, label, equip_type) for the distinct names of ``df``.

    Classification runs once per distinct name and the result (vocabulary-sized)
    is materialised in the shared checkpoint folder, so later joins read a small
    table instead of re-planning and re-running the rule expressions."""
    from upkeep.session import materialize
    d = df.select(F.col(name_col).alias("name")).distinct()
    d = with_equip_type_from_name(with_keyword_label(with_keyword(d, "name")), "name")
    return materialize(d.select("name", "keyword", "label", "equip_type"))
