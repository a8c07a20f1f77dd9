"""Merkle dataset manifest with checkpointed levels.

Every row is a leaf; the leaves of a group (a language), ordered by id, form a
binary hash tree whose last run of a level may hold one node; the group roots,
ordered by group, form a tree of the same kind above them. Of each tree only
every ``every``-th level is stored: the nodes of a stored level are cut into
aligned subtrees of ``2 ** every`` nodes, and each subtree is reduced to the one
node of the next stored level.

A proof is extracted from the top down. Each aligned subtree regenerates its
missing interior nodes from its stored descendants, hands every descendant the
siblings on its way to the subtree's top, appends those that the top itself got
from the subtree above, and discards the interior nodes. Siblings travel only
with stored nodes, a 64th of the level below; at the leaves they are folded at
once, so no proof of a document is ever shuffled or written.

Order within a tree comes from range-sorted files and prefix sums of their
counts (``dense_number``), so a group that holds most rows spreads over many
tasks. Every key that rows meet on is (group, subtree) with at most ``2 **
every`` rows. The driver sees one number a level.

Cases: a null field counts as ``-``; a null id comes first in its group and is
never tampered with; rows with equal id in a group are ordered by their leaf and
each has its own place; empty and very long texts are hashed whole; null groups
form one group, the first; a group of one row is its own root; an empty table
has no root and gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import written
from upkeep.operators.windows import dense_number

EVERY = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the inputs put together."""
    return F.sha2(F.concat(*parts), 256)


def group_key(c: Column) -> Column:
    """A key that is never null and sorts like the group: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return digest(*[field_text(fields[name]) for name in FIELDS])


def document_leaves(docs: DataFrame, group_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``_group, doc_id, leaf, altered`` of every row; ``altered`` is the leaf with 1
    added to ``n_chars`` where 7 divides the unsigned crc32 of the decimal id, and
    null elsewhere."""
    fields = {name: F.col(name) for name in FIELDS}
    marked = F.crc32(F.col(id_col).cast("string")) % 7 == 0
    changed = fields | {"n_chars": F.col("n_chars") + 1}
    return docs.select(group_key(F.col(group_col)).alias("_group"), F.col(id_col).alias("doc_id"), leaf_digest(fields).alias("leaf"),
                       F.when(marked, leaf_digest(changed)).alias("altered"))


@dataclass
class Manifest:
    """``levels``: the stored levels of the group trees, lowest first, each with
    ``_group, pos, n, node`` (the lowest also ``doc_id, altered``); ``top``: those of
    the tree over the group roots, whose lowest nodes keep their ``_name``."""

    levels: list[DataFrame]
    top: list[DataFrame]
    every: int


def _left(n: Column) -> Column:
    """Levels between ``n`` nodes and one."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _next_level(nodes: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1)
    return F.transform(pairs, lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def _subtrees(level: DataFrame, every: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per aligned subtree of ``2 ** every`` nodes: ``_group, block, n,
    rise`` (levels up to its top) and its nodes in order."""
    children = F.array_sort(F.collect_list(F.struct("pos", "node", *extra)))
    return (level.where("n > 1").groupBy("_group", F.shiftright("pos", every).alias("block")).agg(F.max("n").alias("n"), children.alias("children"))
            .withColumn("rise", F.least(_left(F.col("n")), F.lit(every))))


def _raise(level: DataFrame, every: int) -> DataFrame:
    """The next stored level."""
    nodes = F.transform("children", lambda c: c["node"])
    top = F.aggregate(F.sequence(F.lit(1), F.col("rise")), nodes, lambda acc, _: _next_level(acc), lambda acc: F.get(acc, F.lit(0)))
    width = F.lit(1 << every)
    return _subtrees(level, every).select("_group", F.col("block").alias("pos"), F.ceil(F.col("n") / width).cast("long").alias("n"), top.alias("node"))


def _tree(lowest: DataFrame, every: int, name: str) -> list[DataFrame]:
    levels = [lowest]
    most = lowest.agg(F.max("n")).first()[0] or 0  # the nodes of the largest group
    while most > 1:
        levels.append(written(_raise(levels[-1], every), f"{name}-{len(levels) * every}"))
        most = -(-most // (1 << every))
    return levels


def manifest(leaves: DataFrame, every: int = EVERY) -> Manifest:
    """Builds the trees over ``_group, doc_id, leaf, altered`` and stores every ``every``-th level."""
    # written first: range partitioning reads its input twice, the texts should be hashed once
    placed = dense_number(written(leaves, "digests"), "_group", ("doc_id", "leaf"), "pos", "n", start=0)
    lowest = written(placed.select("_group", F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n"),
                                   F.col("leaf").alias("node"), "doc_id", "altered"), "leaves")
    levels = _tree(lowest, every, "level")
    roots = None
    for level in levels:
        found = level.where("n = 1").select(F.col("_group").alias("_name"), "node")
        roots = found if roots is None else roots.unionByName(found)
    ranked = dense_number(roots, [], "_name", "pos", "n", start=0)
    top = written(ranked.select(F.lit(0).alias("_group"), F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n"),
                                "node", "_name"), "group-roots")
    return Manifest(levels, _tree(top, every, "top"), every)


def _descend(level: DataFrame, above: DataFrame, every: int, extra: tuple[str, ...], carry: list[str]) -> DataFrame:
    """The nodes of a stored level with their path to the root: the siblings on the
    way to their subtree's top, then the path of that top. ``path`` has an entry a
    level: ``<`` and the sibling where that stands to the left, ``>`` and it where it
    stands to the right, empty where the node stands alone."""
    rise = F.col("rise")
    regrown = F.aggregate(F.sequence(F.lit(1), rise), F.array(F.transform("children", lambda c: c["node"])),
                          lambda acc, _: F.concat(acc, F.array(_next_level(F.element_at(acc, -1)))))

    def sibling(place: Column, step: Column) -> Column:
        here, nodes = F.call_function("shiftright", place, step), F.get(F.col("tree"), step)
        return (F.when(here % 2 == 1, F.concat(F.lit("<"), F.get(nodes, here - 1)))
                .when(here + 1 < F.size(nodes), F.concat(F.lit(">"), F.get(nodes, here + 1))).otherwise(""))

    def item(child: Column, place: Column) -> Column:
        return F.struct(*[child[c].alias(c) for c in ("pos", "node", *extra)],
                        F.transform(F.sequence(F.lit(0), rise - 1), lambda step: sibling(place, step)).alias("_part"))

    tops = above.select(F.col("_group").alias("_g"), F.col("pos").alias("_p"), F.col("path").alias("_path"), *carry)
    met = _subtrees(level, every, extra).join(tops, (F.col("_group") == F.col("_g")) & (F.col("block") == F.col("_p")))
    out = met.withColumn("tree", regrown).select("_group", "_path", *carry, F.inline(F.transform("children", item)))
    return out.select("_group", "pos", "node", *extra, F.concat("_part", "_path").alias("path"), *carry)


def _paths(levels: list[DataFrame], roots: DataFrame, every: int, extra: tuple[str, ...], carry: list[str]) -> DataFrame:
    """The lowest nodes with their paths; ``roots`` has ``_group, path`` and ``carry`` of each tree's root."""
    tops = roots.select(F.col("_group").alias("_g"), "path", *carry)
    found = None
    for k in reversed(range(len(levels))):
        more = extra if k == 0 else ()
        own = levels[k].where("n = 1").join(tops, F.col("_group") == F.col("_g")).select("_group", "pos", "node", *more, "path", *carry)
        found = own if found is None else own.unionByName(_descend(levels[k], found, every, more, carry))
    return found


def fold(node: Column, path: Column) -> Column:
    """The root that ``node`` leads to along ``path``."""
    return F.aggregate(path, node, lambda acc, s: digest(F.when(s.startswith("<"), F.substring(s, 2, 64)).otherwise(""), acc,
                                                         F.when(s.startswith(">"), F.substring(s, 2, 64)).otherwise("")))


def paths(tree: Manifest) -> DataFrame:
    """``doc_id, leaf, altered, path, subroot, root`` of every leaf."""
    nothing = F.array().cast("array<string>")
    root = tree.top[-1].where("n = 1").select("_group", nothing.alias("path"), F.col("node").alias("root"))
    groups = _paths(tree.top, root, tree.every, ("_name",), ["root"])
    groups = groups.select(F.col("_name").alias("_group"), "path", F.col("node").alias("subroot"), "root")
    out = _paths(tree.levels, groups, tree.every, ("doc_id", "altered"), ["subroot", "root"])
    return out.select("doc_id", F.col("node").alias("leaf"), "altered", "path", "subroot", "root")


def proofs(tree: Manifest) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: each leaf's
    proof, and the root that its altered (else its own) leaf leads to."""
    folded = paths(tree).withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("path")))
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda s: F.substring(s, 2, 64))), 256)
    return folded.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
