"""Registered queries: profile of the raw table."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tiercat.operators import profile as pr
from tiercat.plans import fixtures as fx
from tiercat.plans import sql as S
from tiercat.plans.registry import register

LEVELS = ("category", "sub_category")


def _r6(c):
    return F.round(c.cast("double"), 6)


def _counts(spark, sf_dir):
    """Class counts of both levels: one scan of two columns."""
    return pr.level_counts(fx.txn(spark, sf_dir, with_type=False), LEVELS)


@register("p1_null_counts", S.with_ctes(S.TXN_NULLS, body="""
SELECT count(*) FILTER (WHERE clean_description IS NULL) AS null_clean_description,
       count(*) FILTER (WHERE category IS NULL) AS null_category,
       count(*) FILTER (WHERE sub_category IS NULL) AS null_sub_category
FROM txn_nulls"""))
def p1_null_counts(spark, sf_dir):
    return pr.null_counts(fx.txn_nulls(spark, sf_dir, with_type=False),
                          ("clean_description", "category", "sub_category"))


@register("p6_text_sample", S.with_ctes(S.TXN_NULLS, body="""
SELECT doc_id, substring(clean_description, 1, 80) AS sample,
       (SELECT count(*) FROM txn_nulls WHERE clean_description IS NOT NULL) AS n_nonnull
FROM txn_nulls WHERE clean_description IS NOT NULL ORDER BY doc_id LIMIT 10"""))
def p6_text_sample(spark, sf_dir):
    """P6 + F16: ten first non-null texts (cut to 80 characters) and the non-null count."""
    return pr.text_sample(fx.txn_nulls(spark, sf_dir, with_type=False), "clean_description", "doc_id", 10, 80)


@register("a1_value_counts", S.with_ctes(S.TXN, body="""
SELECT level, label, n, row_number() OVER (PARTITION BY level ORDER BY n DESC, label) AS rank
FROM (SELECT 'category' AS level, category AS label, count(*) AS n FROM txn
      WHERE category IS NOT NULL GROUP BY category
      UNION ALL
      SELECT 'sub_category', sub_category, count(*) FROM txn
      WHERE sub_category IS NOT NULL GROUP BY sub_category)"""))
def a1_value_counts(spark, sf_dir):
    c = _counts(spark, sf_dir).where("label IS NOT NULL")
    w = Window.partitionBy("level").orderBy(F.desc("n"), "label")
    return c.select("level", "label", F.col("n").cast("long"), F.row_number().over(w).cast("long").alias("rank"))


@register("a3_distinct_classes", S.with_ctes(S.TXN_NULLS, body="""
SELECT 'category' AS level, count(DISTINCT category) AS n_distinct,
       count(DISTINCT category) + max(CASE WHEN category IS NULL THEN 1 ELSE 0 END) AS n_distinct_with_null
FROM txn_nulls
UNION ALL
SELECT 'sub_category', count(DISTINCT sub_category),
       count(DISTINCT sub_category) + max(CASE WHEN sub_category IS NULL THEN 1 ELSE 0 END)
FROM txn_nulls"""))
def a3_distinct_classes(spark, sf_dir):
    """A3 (nulls excluded) and A4 (null counted as a class)."""
    c = pr.level_counts(fx.txn_nulls(spark, sf_dir, with_type=False), LEVELS)
    return c.groupBy("level").agg(F.count("label").alias("n_distinct"),
                                  F.count(F.lit(1)).alias("n_distinct_with_null"))


@register("a5_count_stats", S.with_ctes(S.TXN, body="""
SELECT level, round(avg(n), 6) AS mean_n, round(median(n), 6) AS median_n,
       min(n) AS min_n, max(n) AS max_n, round(stddev_samp(n), 6) AS std_n
FROM (SELECT 'category' AS level, category AS label, count(*) AS n FROM txn
      WHERE category IS NOT NULL GROUP BY category
      UNION ALL
      SELECT 'sub_category', sub_category, count(*) FROM txn
      WHERE sub_category IS NOT NULL GROUP BY sub_category)
GROUP BY level"""))
def a5_count_stats(spark, sf_dir):
    c = _counts(spark, sf_dir).where("label IS NOT NULL").groupBy("level").agg(
        F.avg("n").alias("mean_n"), F.median("n").alias("median_n"), F.min("n").cast("long").alias("min_n"),
        F.max("n").cast("long").alias("max_n"), F.stddev_samp("n").alias("std_n"))
    return c.select("level", _r6(F.col("mean_n")).alias("mean_n"), _r6(F.col("median_n")).alias("median_n"),
                    "min_n", "max_n", _r6(F.col("std_n")).alias("std_n"))


@register("a7_imbalance_ratio", S.with_ctes(S.TXN, body="""
SELECT level, round(max(n) / min(n), 6) AS imbalance_ratio
FROM (SELECT 'category' AS level, count(*) AS n FROM txn
      WHERE category IS NOT NULL GROUP BY category
      UNION ALL
      SELECT 'sub_category', count(*) FROM txn
      WHERE sub_category IS NOT NULL GROUP BY sub_category)
GROUP BY level"""))
def a7_imbalance_ratio(spark, sf_dir):
    c = _counts(spark, sf_dir).where("label IS NOT NULL")
    return c.groupBy("level").agg(_r6(F.max("n") / F.min("n")).alias("imbalance_ratio"))


K1_SUB = """sub AS (SELECT sub_category AS label, count(*) AS n FROM txn
            WHERE sub_category IS NOT NULL GROUP BY 1)"""
K1_CAT = """cat AS (SELECT category AS label, count(*) AS n FROM txn
            WHERE category IS NOT NULL GROUP BY 1)"""


@register("k1_top_bottom_classes", S.with_ctes(S.TXN, K1_SUB, K1_CAT, body="""
SELECT * FROM (
  SELECT 'top20_sub' AS which, label, n, row_number() OVER (ORDER BY n DESC, label) AS rank FROM sub)
WHERE rank <= 20
UNION ALL
SELECT * FROM (
  SELECT 'bottom20_sub' AS which, label, n,
         row_number() OVER (ORDER BY n ASC, label DESC) AS rank FROM sub)
WHERE rank <= 20
UNION ALL
SELECT * FROM (
  SELECT 'top10_cat' AS which, label, n, row_number() OVER (ORDER BY n DESC, label) AS rank
  FROM cat)
WHERE rank <= 10"""))
def k1_top_bottom_classes(spark, sf_dir):
    """K1: top 20 / bottom 20 subcategories and top 10 categories by count."""
    c = _counts(spark, sf_dir).where("label IS NOT NULL")
    down = Window.partitionBy("level").orderBy(F.desc("n"), "label")
    up = Window.partitionBy("level").orderBy("n", F.desc("label"))
    c = c.withColumn("d", F.row_number().over(down)).withColumn("u", F.row_number().over(up))
    sub, cat = F.col("level") == "sub_category", F.col("level") == "category"
    pick = lambda name, when, rank: F.when(when, F.struct(F.lit(name).alias("which"), rank.alias("rank")))
    lists = F.array(pick("top20_sub", sub & (F.col("d") <= 20), F.col("d")),
                    pick("bottom20_sub", sub & (F.col("u") <= 20), F.col("u")),
                    pick("top10_cat", cat & (F.col("d") <= 10), F.col("d")))
    return c.select("label", F.col("n").cast("long"),
                    F.explode(F.filter(lists, lambda z: z.isNotNull())).alias("z")) \
        .select("z.which", "label", "n", F.col("z.rank").cast("long").alias("rank"))


@register("k3_sorted_labels", S.with_ctes(S.TXN, body="""
SELECT 'category' AS level, category AS label,
       row_number() OVER (ORDER BY category) - 1 AS pos
FROM (SELECT DISTINCT category FROM txn WHERE category IS NOT NULL)
UNION ALL
SELECT 'sub_category', sub_category, row_number() OVER (ORDER BY sub_category) - 1
FROM (SELECT DISTINCT sub_category FROM txn WHERE sub_category IS NOT NULL)"""))
def k3_sorted_labels(spark, sf_dir):
    c = _counts(spark, sf_dir).where("label IS NOT NULL")
    w = Window.partitionBy("level").orderBy("label")
    return c.select("level", "label", (F.row_number().over(w) - 1).cast("long").alias("pos"))