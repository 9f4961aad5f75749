"""Mixing sources to target weights by systematic sampling.

Every document has expected copies e = target / words of its source. Within a source the
documents stand in order of (size, key, text hash); prefix sums of e, shifted by one random
offset per source, cross integer boundaries, and a document is emitted once per boundary
that its own step crosses. Neighbours in that order have nearly the same size, so the words
taken stay near the target (the error is below the largest document).

The order is one range-partitioned sort over (source, size, key), so a source that holds a
third of all rows spans many tasks; ranks come from counts per (source, partition).

Defined cases: a null text has size 0; a null source is a source of its own, last in order;
a source without words gets target 0 and no copies; rows that repeat a key and text are
ranked one after the other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tiercat.llm.common import body, col, stored, words_in


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2),
                   share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, source_size): ``share`` of all words
    is dealt by weight, sources by code point with null last; a target stops at ``cap``
    times its source and the excess is dealt again by weight until none is above.

    That fixed point is a water level: with the sources ordered by size / weight, a
    prefix is capped and the others stand at level * weight. All sums are of integers, so the
    result does not depend on the order of summation. One row per source goes through one
    task.
    """
    spark = sizes.sparkSession
    num, den = share
    wide = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "slot int, weight long")
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = (sizes.withColumn("slot", (order - 1) % len(weights)).join(wide, "slot")
         .withColumn("ratio", F.col("source_size") / F.col("weight")))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (s.withColumn("below", F.coalesce(F.sum("source_size").over(up), F.lit(0)))
         .withColumn("weight_below", F.coalesce(F.sum("weight").over(up), F.lit(0)))
         .withColumn("all_size", F.sum("source_size").over(everything))
         .withColumn("all_weight", F.sum("weight").over(everything)))
    # level * den * (weight left) if all sources before this one are capped
    s = (s.withColumn("left", num * F.col("all_size") - den * cap * F.col("below"))
         .withColumn("weight_left", F.col("all_weight") - F.col("weight_below"))
         .withColumn("open", den * cap * F.col("source_size") * F.col("weight_left")
                     >= F.col("weight") * F.col("left")))
    level = F.min(F.when(F.col("open"), F.struct("below", "weight_below", "left", "weight_left"))) \
        .over(everything)
    s = s.withColumn("level", level)
    target = F.when(
        F.col("open"),
        (F.col("weight") * F.col("level.left")).cast("double")
        / (den * F.col("level.weight_left")).cast("double"),
    ).otherwise((cap * F.col("source_size")).cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def offset(seed: int) -> F.Column:
    """The source's random offset in [0, 1): a multiple of 1/1024, so sums with whole steps
    are exact."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % 1024 / F.lit(1024.0)


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
         weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), cap: int = 2,
         seed: int = 42) -> DataFrame:
    """One row per document: key, text_hash, source, size, source_size, target, copies, taken."""
    narrow = stored(docs.select(
        col(key).alias("key"), col(source).cast("string").alias("source"),
        words_in(text).alias("size"), F.xxhash64(body(text)).alias("text_hash")), "mix-sizes")
    order = [F.col("source").asc_nulls_last(), "size", "key", "text_hash"]
    ranked = stored(
        narrow.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id()), "mix-order")
    parts = ranked.groupBy("source", "part").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    totals = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")),
                            weights, share, cap)
    same = F.col("p.source").eqNullSafe(F.col("t.source"))
    each = parts.alias("p").join(totals.alias("t"), same).select(
        "p.source", "p.part", "p.before", "t.source_size", "t.target")
    each = each.withColumn("u", offset(seed)).withColumn(
        "e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    r = ranked.alias("r").join(
        each.alias("e"), (F.col("r.part") == F.col("e.part"))
        & F.col("r.source").eqNullSafe(F.col("e.source"))).select(
        "r.key", "r.text_hash", "r.source", "r.size", "e.source_size", "e.target", "e.u",
        F.col("e.e").alias("step"), (F.col("r.at") + F.col("e.before")).alias("rank"))
    reach = lambda k: F.floor(F.col("u") + k * F.col("step"))
    copies = (reach(F.col("rank") + 1) - reach(F.col("rank"))).cast("long")
    return r.withColumn("copies", copies).select(
        "key", "text_hash", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as the plan says. Only rows that repeat key
    and text and get unlike numbers of copies are numbered."""
    p = plan(docs, key, text, source, **options)
    # rows that repeat key and text are alike for the mix: mostly all get as many copies, else the first some
    # of them get one copy more
    g = stored(p.groupBy("key", "text_hash").agg(
        F.min("copies").alias("low"), F.max("copies").alias("high"),
        (F.sum("copies") - F.count(F.lit(1)) * F.min("copies")).alias("more")).where("high > 0"), "mix-copies")
    d = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(key).alias("key"),
                    F.xxhash64(body(text)).alias("text_hash")).alias("d")

    def met(groups: DataFrame) -> DataFrame:
        return d.join(groups.alias("g"), F.col("d.key").eqNullSafe(F.col("g.key"))
                      & (F.col("d.text_hash") == F.col("g.text_hash"))).select("row", "d.key", "d.text_hash", "low", "high", "more")

    even = met(g.where("low = high")).select("row", F.col("high").alias("copies"))
    no = F.row_number().over(Window.partitionBy("key", "text_hash").orderBy(F.lit(0)))
    uneven = met(g.where("low < high")).withColumn("no", no).select(
        "row", F.when(F.col("no") <= F.col("more"), F.col("low") + 1).otherwise(F.col("low")).alias("copies"))
    j = even.unionByName(uneven.where("copies > 0")).select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return j.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
