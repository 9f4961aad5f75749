"""Merkle manifest of a dataset by sibling-shift self-joins.

Every row is a leaf: the sha256 of its fields. The leaves of a group (null is a group), in order of
their keys, are the lowest level of the group's tree.

1. Leaves get their places by ranges of (group, key, leaf), so no group is sorted in one task.
2. A level: every node sends its digest to the computed indices of its run's other slots (its
   place moved by slot offsets; for two children that is the place XOR 1), and the nodes equijoin
   with what was sent to them by (tree, place). So each node holds its siblings left and right of it.
3. The rows of slot zero emit the parents, the digest of the whole run. A tree ends when one node
   is left, its subroot. The subroots, in order of their groups, are the leaves of one more tree.
4. Audit paths are handed down from the parents, level by level: an array of the siblings to the
   left and to the right. Folding a leaf along its path gives the root.

Levels are written tables, as many as the logarithm of the largest group; only their number and the
root itself reach the driver. Every join is by (tree, place), which no key shares; the tree of a row
meets its subroot by a join on the tree.

Defined cases: a null field counts as ``-``, so null and empty differ; rows that share a key, null
keys included (they come first), are ordered by their leaves, and rows equal in all fields are leaves of
their own with equal digests; a lone leaf is its subroot, a lone subroot the root, with an empty path;
a run of one node is hashed all the same; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tiercat.llm.common import col, ranked, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(values: list[Column]) -> Column:
    """sha256 (lowercase hex) of values, each ``-`` if null, else its byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, at, digest, ...) with the joined digests of the siblings ``left`` and
    ``right`` of each node."""
    slot = F.col("at") % arity
    sent = nodes.select("tree", "at", "digest", F.explode(F.sequence(F.lit(0), F.lit(arity - 1))).alias("to")) \
        .where(F.col("to") != slot).select(
        F.col("tree"), (F.col("at") - slot + F.col("to")).alias("at"),
        F.struct(slot.alias("slot"), "digest").alias("sibling"))
    met = nodes.join(sent, ["tree", "at"], "left").groupBy(*nodes.columns).agg(
        F.sort_array(F.collect_list("sibling")).alias("others"))
    side = lambda keep: F.array_join(F.transform(F.filter("others", keep), lambda x: x["digest"]), "")
    return met.select(*nodes.columns, side(lambda x: x["slot"] < slot).alias("left"),
                      side(lambda x: x["slot"] > slot).alias("right"))


def forest(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels (tree, at, left, right, ...) of the trees that have several nodes there, from the
    leaves (tree, at, size, digest, ...) upwards, and the roots (tree, digest)."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    levels, roots, nodes = [], leaves.where("size = 1").select("tree", "digest"), leaves
    while most > 1:
        level = stored(siblings(nodes.where("size > 1"), arity), f"merkle-{len(levels)}")
        levels.append(level)
        nodes = level.where(F.col("at") % arity == 0).select(
            "tree", F.floor(F.col("at") / arity).alias("at"), F.ceil(F.col("size") / arity).alias("size"),
            F.sha2(F.concat("digest", "right"), 256).alias("digest"))
        roots = roots.unionByName(nodes.where("size = 1").select("tree", "digest"))
        most = -(-most // arity)
    return levels, roots


def paths(levels: list[DataFrame], leaves: DataFrame, arity: int) -> DataFrame:
    """``leaves`` with ``path``: the siblings of the leaf and of each node above it."""
    path = None
    for level in reversed(levels):
        step = F.array(F.struct("left", "right"))
        if path is None:
            path = level.withColumn("path", step)
        else:
            up = path.select(F.col("tree"), F.col("at").alias("up"), F.col("path").alias("rest"))
            path = (level.withColumn("up", F.floor(F.col("at") / arity)).join(up, ["tree", "up"], "left")
                    .withColumn("path", F.when(F.col("rest").isNull(), step).otherwise(F.concat(step, "rest"))))
    kind = "array<struct<left:string,right:string>>"
    alone = leaves.where("size = 1").withColumn("path", F.array().cast(kind))
    if path is None:
        return alone
    return alone.unionByName(path.select(*leaves.columns, F.col("path").cast(kind)))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS,
             arity: int = 8, carry: dict[str, Column] | None = None) -> DataFrame:
    """(key, group, at, leaf, subroot, root, path) of every row of ``docs``; ``carry`` names further
    columns, computed on the rows of ``docs``, that come along."""
    carry = carry or {}
    rows = docs.select(
        col(key).alias("key"), col(group).cast("string").alias("group"), digest([col(f) for f in fields]).alias("digest"),
        F.struct(*[c.alias(n) for n, c in carry.items()] or [F.lit(0).alias("none")]).alias("carried"),
        F.monotonically_increasing_id().alias("no"))
    leaves = ranked(rows, "group", [F.col("key").asc_nulls_first(), F.col("digest"), F.col("no")], "merkle-leaves")
    leaves = stored(leaves.withColumnRenamed("start", "tree").drop("no"), "merkle-places")
    levels, roots = forest(leaves, arity)
    roots = stored(roots, "merkle-subroots")

    top = ranked(roots.withColumn("all", F.lit("")), "all", [F.col("tree")], "merkle-order").select(
        F.col("tree").alias("subtree"), F.col("start").alias("tree"), "at", "size", "digest")
    top = stored(top, "merkle-top")
    top_levels, top_root = forest(top, arity)
    root = top_root.first()
    top = paths(top_levels, top, arity).select(
        F.col("subtree").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("top_path"))
    out = paths(levels, leaves, arity).join(top, "tree")
    return out.select("key", "group", "at", F.col("digest").alias("leaf"), "subroot",
                      F.lit(root.digest if root else None).cast("string").alias("root"),
                      F.concat("path", "top_path").alias("path"),
                      *[F.col(f"carried.{n}").alias(n) for n in carry])


def proof(path: Column) -> Column:
    """sha256 of all siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` gives along ``path``."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))
