"""Keyword mining from linear weights.

Inputs are long tables: ``presence`` (doc, class, term) of training documents restricted
to the vocabulary, ``docs`` (doc, class) for class sizes, and ``weights`` (class, term,
weight), one row per class and vocabulary term (a linear model's coefficient matrix).
The dense class × term statistics grid of the reference is never built: statistics exist
for observed (class, term) pairs, and the ranked candidates (2 × top_n per class) look up
theirs with a left join, so a zero-support candidate keeps support 0 exactly as in the
grid.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window, functions as F


# The reference's keyword defaults (top-n per direction, support and
# dominance thresholds, the high-dominance escape).
TOP_N = 40
MIN_SUPPORT_CLASS = 3
MIN_DOMINANCE = 0.05
HIGH_DOMINANCE = 0.5


def class_sizes(docs: DataFrame, cls: str) -> DataFrame:
    """Documents per class (``n_class``)."""
    return docs.groupBy(F.col(cls).alias("class_id")).agg(F.count(F.lit(1)).alias("n_class"))


def pair_supports(presence: DataFrame, levels, term: str = "term") -> DataFrame:
    """``(*levels, term, n)``: documents per combination of labels and term, the one pass over the
    presence rows that every level's statistics are sums of. ``term`` may name the terms' index."""
    return presence.groupBy(*levels, term).agg(F.count(F.lit(1)).alias("n"))


def level_statistics(supports: DataFrame, sizes: DataFrame, cls: str) -> DataFrame:
    """A13 of one level from :func:`pair_supports`: ``(class_id, term, support_class,
    support_total, n_class, dominance, p_in_class)`` for every observed (class, term) pair.
    Both counts are sums of the small frame; no window gathers a term's rows."""
    sc = supports.groupBy(F.col(cls).alias("class_id"), "term").agg(F.sum("n").alias("support_class"))
    total = supports.groupBy("term").agg(F.sum("n").alias("support_total"))
    st = sc.join(total, "term").join(sizes, "class_id")
    return (st.withColumn("dominance", F.col("support_class") / F.col("support_total"))
              .withColumn("p_in_class", F.col("support_class") / F.col("n_class")))


def term_statistics(presence: DataFrame, docs: DataFrame, cls: str) -> DataFrame:
    """A13 of one level straight from the presence rows."""
    return level_statistics(pair_supports(presence, [cls]), class_sizes(docs, cls), cls)


def top_terms(weights: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Per class the ``top_n`` largest weights ('include', weight desc, term asc) and
    the ``top_n`` smallest ('exclude', weight asc, term asc). Signs are not checked (T9).

    ``row_number() <= n`` lets Spark insert a per-partition group limit before the
    class-keyed shuffle, so only top_n rows per class and task move."""
    inc = Window.partitionBy("class_id").orderBy(F.col("weight").desc(), F.col("term"))
    exc = Window.partitionBy("class_id").orderBy(F.col("weight").asc(), F.col("term"))
    a = (weights.withColumn("rank", F.row_number().over(inc)).where(F.col("rank") <= top_n)
         .withColumn("direction", F.lit("include")))
    b = (weights.withColumn("rank", F.row_number().over(exc)).where(F.col("rank") <= top_n)
         .withColumn("direction", F.lit("exclude")))
    return a.unionByName(b)


def candidate_statistics(cands: DataFrame, stats: DataFrame, sizes: DataFrame) -> DataFrame:
    """J7 + J8: statistics of each ranked candidate. A candidate keeps support 0 when its
    term occurs in training documents of other classes only; it is dropped when the term
    occurs nowhere in training (no statistics) or its class has no documents."""
    totals = stats.select("term", "support_total").distinct()
    pair = stats.select("class_id", "term", "support_class")
    j = (cands.join(pair, ["class_id", "term"], "left")
              .join(totals, "term", "inner")
              .join(sizes, "class_id", "inner"))
    sc = F.coalesce(F.col("support_class"), F.lit(0))
    return (j.withColumn("support_class", sc.cast("long"))
             .withColumn("dominance", F.col("support_class") / F.col("support_total"))
             .withColumn("p_in_class", F.col("support_class") / F.col("n_class")))


def keep_predicate(min_support_class: int = MIN_SUPPORT_CLASS,
                   min_dominance: float = MIN_DOMINANCE,
                   high_dominance: float = HIGH_DOMINANCE):
    """(support >= min_support and dominance >= min_dominance) or dominance >= high."""
    s, d = F.col("support_class"), F.col("dominance")
    return ((s >= min_support_class) & (d >= min_dominance)) | (d >= high_dominance)


def keywords(weights: DataFrame, presence: DataFrame, docs: DataFrame, cls: str,
             top_n: int = TOP_N, apply_filtering: bool = True,
             min_support_class: int = MIN_SUPPORT_CLASS,
             min_dominance: float = MIN_DOMINANCE, stats: DataFrame | None = None,
             sizes: DataFrame | None = None) -> DataFrame:
    """Rank first, then filter (T9): ``(class_id, direction, rank, term, weight
    [, support_class, dominance])``. Without filtering the ranked lists are returned.
    ``stats`` and ``sizes`` may pass already computed statistics and class sizes."""
    cands = top_terms(weights, top_n)
    if not apply_filtering:
        return cands.select("class_id", "direction", "rank", "term", "weight")
    if stats is None:
        stats = term_statistics(presence, docs, cls)
    c = candidate_statistics(cands, stats, class_sizes(docs, cls) if sizes is None else sizes)
    return (c.where(keep_predicate(min_support_class, min_dominance))
             .select("class_id", "direction", "rank", "term", "weight", "support_class",
                     "dominance"))


def keyword_totals(kw: DataFrame, names: DataFrame, level: str = "level") -> DataFrame:
    """Classes, include and exclude counts per level. ``names`` is (level, class_id) of all
    classes: one without keywords counts as well."""
    n = names.groupBy(level).agg(F.countDistinct("class_id").alias("n_classes"))
    k = kw.groupBy(level).agg(
        F.count_if(F.col("direction") == "include").alias("n_include"),
        F.count_if(F.col("direction") == "exclude").alias("n_exclude"))
    none = F.lit(0).cast("long")
    return n.join(k, level, "left").select(
        level, "n_classes", F.coalesce("n_include", none).alias("n_include"),
        F.coalesce("n_exclude", none).alias("n_exclude"))


def keyword_lists(kw: DataFrame, names: DataFrame) -> DataFrame:
    """F15 + F11: ``(class_name, include, exclude)`` for every class of ``names`` (name, id), lists
    in rank order, empty where a class has no keyword; dominance rounded to 3 digits. Keywords
    without statistics (no filtering) have term and weight only. Lists hold at most 2 x top_n rows."""
    fields = [F.col(c) for c in ("rank", "term", "weight")]
    if "support_class" in kw.columns:
        fields += [F.col("support_class"), F.round(F.col("dominance"), 3).alias("dominance")]
    item = F.struct(*fields)
    per = kw.groupBy("class_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("direction") == d, item))).alias(d)
        for d in ("include", "exclude")])
    n = names.select(F.col(names.columns[1]).alias("class_id"),
                     F.col(names.columns[0]).alias("class_name"))
    lists = []
    for d in ("include", "exclude"):
        empty = F.array().cast(per.schema[d].dataType)
        lists.append(F.transform(F.coalesce(d, empty), lambda z: z.dropFields("rank")).alias(d))
    return n.join(per, "class_id", "left").select("class_name", *lists)


def keyword_documents(kw: DataFrame, names: DataFrame, level: str) -> DataFrame:
    """S8 rows: ``(level, class_name, keywords)``, one JSON object per class."""
    return keyword_lists(kw, names).select(
        F.lit(level).alias("level"), "class_name",
        F.to_json(F.struct("include", "exclude")).alias("keywords"))


def keyword_file(documents: DataFrame, metadata: dict) -> DataFrame:
    """The whole keyword document as JSON lines ``(section, level, class_name, keywords)``: the
    metadata line first, then one line per level and class."""
    meta = documents.sparkSession.createDataFrame(
        [("metadata", None, None, json.dumps(metadata))],
        "section string, level string, class_name string, keywords string")
    return meta.unionByName(documents.withColumn("section", F.lit("classes")))
