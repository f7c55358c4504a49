"""A manifest of a dataset as Merkle trees of its rows, with a path to the root for each row.

A row's leaf hashes its fields, each with its length. The leaves of a group (a language, say) in order of their ids are a
tree: of every two consecutive nodes the hash, a last single one hashed by itself, until one node is left; the roots of
the groups in order form one more tree, whose root stands for the dataset.

Stored is the preimage of each parent, the digests of its children one behind the other. A leaf joins the preimages of
its ancestors; in each it has a slot of 64 characters. Without its slot a preimage is the sibling, so the siblings are
cut out of the path, and with another digest spliced into the slot it hashes to the parent that this digest would have,
so a claimed leaf is folded to a root with nothing else at hand.

Trees are made and read in blocks of 2**``HEIGHT`` neighbours, a row each: a block holds its levels of preimages, and its
root is a node of the next height. From the top down each block joins the path of its root once, so upper preimages are
not multiplied by the leaves before the result, and no key is hotter than a block. Places in a group come from range
partitions and their counts, so a group of any size is many tasks. All of it is DataFrame work.

Defined results: null fields hash as ``-``; a null group is a group of its own, before all others; null ids come first;
rows with equal ids are ordered by leaf, and then by claim; repeated rows are leaves of their own; a single leaf is its own root;
an empty table has no rows. Columns not asked for are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, saved

#: Levels of a block, and characters of a digest.
HEIGHT, SLOT = 8, 64
BLOCK = 1 << HEIGHT
#: Rows of a range partition.
RANGE_ROWS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<preimage string, slot int>>"


def _column(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def leaf(fields: Sequence[str | Column] = FIELDS) -> Column:
    """The leaf of a row: SHA-256 of its fields, each ``-`` or its UTF-8 bytes counted and given."""
    texts = [_column(c).cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with a column ``tree``) and the place ``at`` of each in its tree by ``order``, of ``n`` in the tree."""
    rows = saved(rows)
    # ties are spread by a number of their own, else rows that are all equal would be one range
    tied = rows.withColumn("_t", F.monotonically_increasing_id())
    cut = tied.repartitionByRange(parts(rows.count(), RANGE_ROWS), "tree", *order, "_t").sortWithinPartitions("tree", *order, "_t").drop("_t")
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    cut = saved(cut.select("*", F.spark_partition_id().alias("_part"), inside.alias("_in")))
    runs = cut.groupBy("tree", "_part").agg(F.count("*").alias("_c"), F.min("_in").alias("_low"))
    before, all_ = W.partitionBy("tree").orderBy("_part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("tree")
    runs = saved(runs.select("tree", "_part", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_low")).alias("_shift"), F.sum("_c").over(all_).alias("n")))
    return cut.join(runs, ["tree", "_part"]).withColumn("at", F.col("_in") + F.col("_shift")).drop("_part", "_in", "_shift")


def _levels(n: Column) -> Column:
    """Levels above a block's nodes, of a tree with ``n`` nodes at its height."""
    needed = F.aggregate(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), F.lit(0), lambda k, i: k + F.when(F.call_function("shiftleft", F.lit(1).cast("bigint"), i) < n, 1).otherwise(0))
    return F.when(n > BLOCK, HEIGHT).otherwise(needed)


def _climbed(nodes: Column, levels: Column) -> Column:
    """The preimages of each level above ``nodes``, and the digests of the last."""

    def climb(state, _):
        below = state.getField("nodes")
        pairs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int"))
        made = F.transform(pairs, lambda i: F.concat(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.lit(""))))
        return F.struct(F.transform(made, lambda p: F.sha2(p, 256)).alias("nodes"), F.concat(state.getField("levels"), F.array(made)).alias("levels"))

    start = F.struct(nodes.alias("nodes"), F.array().cast("array<array<string>>").alias("levels"))
    return F.aggregate(F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>")), start, climb)


def blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """(tree, block, n, nodes, levels, root): the blocks of nodes (tree, at, n, digest), with what they carry."""
    own = F.sort_array(F.collect_list(F.struct("at", "digest", *carried)))
    held = nodes.groupBy("tree", F.floor(F.col("at") / BLOCK).cast("bigint").alias("block")).agg(F.max("n").alias("n"), own.alias("nodes"))
    grown = _climbed(F.transform("nodes", lambda x: x.digest), _levels(F.col("n")))
    return held.withColumn("_up", grown).select("tree", "block", "n", "nodes", F.col("_up.levels").alias("levels"), F.element_at("_up.nodes", 1).alias("root"))


def grown(leaves: DataFrame, *carried: str) -> list[DataFrame]:
    """Blocks of every height, lowest first, each a written table; the last height has one block a tree."""
    heights = [saved(blocks(leaves, *carried))]
    while (heights[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        below = heights[-1].where(F.col("n") > BLOCK)
        up = below.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).cast("bigint").alias("n"), F.col("root").alias("digest"))
        heights.append(saved(blocks(up)))
    return heights


def roots(heights: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    return reduce(DataFrame.unionByName, (h.where(F.col("n") <= BLOCK).select("tree", "root") for h in heights))


def preimages(heights: list[DataFrame]) -> DataFrame:
    """(tree, level, node, preimage) of every parent: the manifest as plain rows."""
    out = []
    for k, height in enumerate(heights):
        rows = height.select("tree", "block", F.posexplode("levels").alias("_level", "_row")).select("tree", "block", "_level", F.posexplode("_row").alias("_i", "preimage"))
        node = F.col("block") * F.call_function("shiftright", F.lit(BLOCK), F.col("_level") + 1) + F.col("_i")
        out.append(rows.select("tree", (F.col("_level") + 1 + k * HEIGHT).alias("level"), node.alias("node"), "preimage"))
    return reduce(DataFrame.unionByName, out)


def _inside(levels: Column, i: Column) -> Column:
    """The path of the ``i``-th node of a block within it: on each level the parent's preimage and the own slot."""
    return F.transform(levels, lambda row, k: F.struct(
        F.get(row, F.call_function("shiftright", i, k + 1)).alias("preimage"), F.call_function("shiftright", i, k).bitwiseAND(1).cast("int").alias("slot")
    ))


def paths(heights: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, node, path, ..) of every leaf: ``above`` has a path beyond each tree's root, (tree, path), and further
    columns of a tree, which are passed down with it."""
    more, found = [c for c in above.columns if c not in ("tree", "path")], None
    for height in reversed(heights):
        tops = above.join(height.where(F.col("n") <= BLOCK).select("tree"), "tree", "left_semi").withColumn("block", F.lit(0).cast("bigint"))
        if found is not None:
            tops = tops.unionByName(found.select("tree", F.col("node.at").alias("block"), "path", *more))
        met = height.select("tree", "block", "nodes", "levels").join(saved(tops), ["tree", "block"])
        each = F.transform("nodes", lambda x, i: F.struct(x.alias("node"), F.concat(_inside(F.col("levels"), i), F.col("path")).alias("path")))
        found = met.select("tree", *more, F.explode(each).alias("_e")).select("tree", "_e.node", "_e.path", *more)
    return found


def siblings(path: str | Column) -> Column:
    """The siblings of a path's nodes, level by level: each preimage without the own slot."""
    return F.transform(_column(path), lambda p: F.concat(
        F.substring(p.preimage, F.lit(1), p.slot * SLOT), F.substring(p.preimage, p.slot * SLOT + SLOT + 1, F.lit(SLOT))
    ))


def folded(digest: str | Column, path: str | Column) -> Column:
    """The root that a leaf's digest leads to: on each level it is spliced into its slot of the preimage."""
    return F.aggregate(_column(path), _column(digest), lambda h, p: F.sha2(F.concat(
        F.substring(p.preimage, F.lit(1), p.slot * SLOT), h, F.substring(p.preimage, p.slot * SLOT + SLOT + 1, F.lit(SLOT))
    ), 256))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS, claimed: Sequence[str | Column] | None = None) -> DataFrame:
    """(id, group, leaf, claim, path, subroot, root) of every row.

    ``claim`` is the leaf of the fields ``claimed``, what somebody else holds the row to be; the leaf itself if there
    are none. ``path`` leads from the leaf over its group's root to the root of all.
    """
    group = _column(group_col).cast("string")
    own = leaf(fields)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"), _column(id_col).alias("id"), own.alias("digest"), (leaf(claimed) if claimed else own).alias("claim")
    )
    heights = grown(placed(rows, "id", "digest", "claim"), "id", "claim")
    tops = saved(roots(heights))
    # the groups' roots are the leaves of one more tree
    upper = grown(placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("digest")), "group"), "group")
    root = roots(upper).select("root", F.array().cast(_PATH).alias("path"), F.lit("").alias("tree"))
    above = paths(upper, root).select(F.col("node.group").alias("tree"), "path", F.col("node.digest").alias("subroot"), "root")
    found = paths(heights, saved(above))
    named = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    return found.select(F.col("node.id").alias(id_col), named.alias("group"), F.col("node.digest").alias("leaf"), F.col("node.claim").alias("claim"), "path", "subroot", "root")
