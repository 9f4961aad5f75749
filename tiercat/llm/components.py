"""Connected components of an undirected graph by alternating star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tiercat.llm.common import stored


def _large(e: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on its smallest neighbour (or itself)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours hang on the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node reachable.

    Each round writes its edge list as a table; rounds are about the logarithm of the longest
    path, and end when every edge hangs on a root, which one aggregate tells. Self-links are
    allowed and keep a node in the result.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    loops = e.where("u = v").select("u").distinct()
    e = stored(e.where("u <> v").distinct(), "edges")
    mark = None
    while True:
        e = stored(_small(_large(e).where("u <> v").distinct()).where("u <> v").distinct(), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if not now[0] or now == mark:
            break
        mark = now
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    alone = loops.select(F.col("u").alias("node")).join(out, "node", "left_anti")
    return out.unionByName(alone.select("node", F.col("node").alias("root")))
