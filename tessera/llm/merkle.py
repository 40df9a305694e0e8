"""A Merkle manifest of a table: one digest per row, one tree per part, one root over the parts, a proof per row.

Every node carries the interval [lo, hi) of the leaf ranks it covers in its tree. Levels are built bottom up: nodes whose
intervals start in the same bucket of ``fanout ** level`` ranks become one node, which keeps its children's intervals and
digests. Ancestors are attached top down, level by level: a node meets the nodes one level above in its own bucket and
keeps the one whose interval contains its own. What that interval holds besides the node's own, left and right of it, are
its siblings. Levels shrink by ``fanout``, so a leaf takes part in one join, however deep its tree is; each level is
written to the shared folder, and ranks come from range partitions, so no part passes through one task.

A digest H is the lowercase hex SHA-256 of the concatenated inputs, digests as hex text. A field is ``-`` if null, else
its UTF-8 byte count, ``:`` and its value. Rows of a part (null is a part of its own, the first) are ordered by key (null
first), rows that share a key by digest; equal rows have equal digests and proofs. The last run of a level may be short,
a run of one node too is hashed; a part of one row is its own subroot, a table of one part has that subroot as its root.
An empty table has no root and no rows. Extra columns are ignored; a tree's digests never depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.operators.ranking import rank_within

FANOUT = 8
#: What a leaf of ``documents`` is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """One input of a leaf."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def part_name(part: Column) -> Column:
    """A name without nulls that sorts as the part does: null first, then the values byte by byte."""
    text = part.cast("string")
    return F.when(part.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), text))


def levels_of(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Node tables from the leaves up, each (tree, n, lo, hi, digest), above the leaves also kids: its children's (lo,
    hi, digest) from left to right. ``leaves``: (tree, n leaves of the tree, lo, hi, digest), stored."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    out, width = [leaves.select("tree", "n", "lo", "hi", "digest")], 1
    while width < most:
        width *= fanout
        kid = F.struct("lo", "hi", "digest")
        runs = (out[-1].where("hi - lo < n")  # a tree that has come down to one node is complete
                .groupBy("tree", "n", F.floor(F.col("lo") / width).alias("bucket"))
                .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(kid)).alias("kids")))
        joined = F.array_join(F.transform("kids", lambda k: F.lower(F.hex(k["digest"]))), "")
        out.append(stored(runs.select("tree", "n", "lo", "hi", F.unhex(F.sha2(joined, 256)).alias("digest"), "kids"),
                          "merkle-level"))
    return out


def subroots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the node that covers its whole tree."""
    tops = [nodes.where("hi - lo = n").select("tree", "digest") for nodes in levels]
    out = tops[0]
    for more in tops[1:]:
        out = out.union(more)
    return out


def _outside(kids: Column, keep: Callable[[Column], Column]) -> Column:
    """The digests of the children that ``keep`` names, as hex text from left to right."""
    return F.array_join(F.transform(F.filter(kids, keep), lambda k: F.lower(F.hex(k["digest"]))), "")


def _attached(nodes: DataFrame, above: DataFrame, width: int) -> DataFrame:
    """``nodes`` with ``path``: for each ancestor, from the nearest to the tree's root, the digests of the siblings left
    and right of the path. ``above``: the nodes one level up with their own path; ``width``: ranks of a bucket there."""
    p = above.select(F.col("tree").alias("p_tree"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "kids",
                     F.col("path").alias("p_path"))
    holds = ((F.col("tree") == F.col("p_tree")) & (F.floor(F.col("lo") / width) == F.floor(F.col("p_lo") / width))
             & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))
    step = F.struct(_outside(F.col("kids"), lambda k: k["hi"] <= F.col("lo")).alias("left"),
                    _outside(F.col("kids"), lambda k: k["lo"] >= F.col("hi")).alias("right"))
    path = F.when(F.col("p_tree").isNull(), _no_steps()).otherwise(F.concat(F.array(step), F.col("p_path")))
    return nodes.join(p, holds, "left").withColumn("path", path).drop("p_tree", "p_lo", "p_hi", "p_path")


def _no_steps() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def paths(leaves: DataFrame, levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """``leaves`` (with any further columns) and the ``path`` of each up to its tree's root."""
    if len(levels) == 1:
        return leaves.withColumn("path", _no_steps())
    above = levels[-1].withColumn("path", _no_steps())
    for level in range(len(levels) - 2, 0, -1):
        own = _attached(levels[level].withColumnRenamed("kids", "own_kids"), above, fanout ** (level + 1))
        above = stored(own.drop("kids").withColumnRenamed("own_kids", "kids"), "merkle-paths")
    return _attached(leaves, above, fanout).drop("kids")


def fold(path: Column, digest: Column) -> Column:
    """The root that follows from a leaf's digest (hex) and the siblings along its path."""
    return F.aggregate(path, digest, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


@dataclass
class Manifest:
    """``leaves``: (key, tree, n, lo, hi, digest, presented); ``levels``: node tables of the parts' trees;
    ``top_leaves``, ``top_levels``: the tree over the subroots; ``root``: hex, None for an empty table."""
    leaves: DataFrame
    levels: list[DataFrame]
    top_leaves: DataFrame
    top_levels: list[DataFrame]
    root: str | None
    fanout: int


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with n, lo and hi, in the given order within ``tree``; stored."""
    placed = stored(rank_within(rows, ["tree"], order, "lo"), "merkle-ranks")
    sizes = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    return stored(placed.join(sizes, "tree").withColumn("hi", F.col("lo") + 1), "merkle-leaves")


def build(docs: DataFrame, digest: Column, part: Column, key: Column, presented: Column | None = None,
          fanout: int = FANOUT) -> Manifest:
    """The manifest of ``docs``. ``digest``: a row's leaf digest; ``presented``: the leaf digest of what is held against
    the manifest later (hex, null where that is the same)."""
    rows = stored(docs.select(key.alias("key"), part_name(part).alias("tree"), F.unhex(digest).alias("digest"),
                              F.unhex(F.lit(None).cast("string") if presented is None else presented)
                              .alias("presented")), "merkle-digests")
    leaves = _ranked(rows, ["key", "digest"])
    levels = levels_of(leaves, fanout)
    parts = subroots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top_leaves = _ranked(parts, ["name"])
    top_levels = levels_of(top_leaves, fanout)
    found = subroots(top_levels).select(F.lower(F.hex("digest"))).first()
    return Manifest(leaves, levels, top_leaves, top_levels, found[0] if found else None, fanout)


def proofs(m: Manifest) -> DataFrame:
    """One row per leaf: key, leaf, subroot, root, path (left and right siblings from the leaf to the root),
    proof_sha256 (H of all siblings, left to right and level by level), folded_root (from the presented leaf, else the
    own, and the path), verified."""
    top = paths(m.top_leaves, m.top_levels, m.fanout).select(
        F.col("name").alias("tree"), F.lower(F.hex("digest")).alias("subroot"), F.col("path").alias("top_path"))
    own = paths(m.leaves.select("key", "tree", "n", "lo", "hi", "digest", "presented"), m.levels, m.fanout)
    whole = own.join(top, "tree").withColumn("path", F.concat("path", "top_path"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    shown = F.lower(F.hex(F.coalesce("presented", "digest")))
    return whole.select(
        "key", F.lower(F.hex("digest")).alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"), "path",
        F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("path"), shown).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
