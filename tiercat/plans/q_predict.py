"""Registered queries: hierarchical prediction on deterministic probabilities (K4, K5, J3,
J4, F9, P14, M5, M7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tiercat.functions.arrays import argmax, mask_to_zero
from tiercat.operators import predict as pd_
from tiercat.operators import prepare as prep
from tiercat.plans import fixtures as fx
from tiercat.plans import sql as S
from tiercat.plans.q_metrics import HIER_SQL, preds_val, scores_val
from tiercat.plans.registry import register

PREP = S.prepared_txn()


def _r6(c):
    return F.round(c.cast("double"), 6)


@register("k5_argmax", S.with_ctes(PREP, S.class_counts_k(), f"""
s AS (SELECT p.doc_id, {S.fine("p.doc_id", "k.k_cat")} AS cf, {S.coarse("p.doc_id", "k.k_cat")} AS cc,
             {S.fine("p.doc_id", "k.k_sub")} AS sf
      FROM prepared p, k WHERE p.split = 'val')""", body="""
SELECT doc_id,
       CAST(list_position(cf, list_max(cf)) - 1 AS BIGINT) AS cat_fine,
       CAST(list_position(cc, list_max(cc)) - 1 AS BIGINT) AS cat_coarse,
       CAST(list_position(sf, list_max(sf)) - 1 AS BIGINT) AS sub_fine
FROM s"""))
def k5_argmax(spark, sf_dir):
    """K5: argmax with the lowest index on ties (coarse probabilities hold ties)."""
    p = fx.prepared_txn(spark, sf_dir)
    k_cat, k_sub = fx.class_count(p.categories), fx.class_count(p.subcategories)
    v, key = p.split("val"), F.col("doc_id")
    return v.select("doc_id",
                    argmax(fx.fine_scores(key, k_cat)).cast("long").alias("cat_fine"),
                    argmax(fx.coarse_scores(key, k_cat)).cast("long").alias("cat_coarse"),
                    argmax(fx.fine_scores(key, k_sub)).cast("long").alias("sub_fine"))


@register("j4_allowed_lookup", S.with_ctes(PREP, S.scores(coarse_cat=True), body="""
SELECT s.doc_id, CAST(list_position(s.cat_prob, list_max(s.cat_prob)) - 1 AS BIGINT) AS pred_category_id,
       array_to_string(m.sub_ids, ',') AS allowed
FROM scores s LEFT JOIN cmap m
  ON m.category_id = list_position(s.cat_prob, list_max(s.cat_prob)) - 1"""))
def j4_allowed_lookup(spark, sf_dir):
    """Allowed subcategory ids of the predicted category (left join)."""
    s, p = scores_val(spark, sf_dir, coarse=True)
    d = pd_.with_allowed(s.withColumn("pred_category_id", argmax(F.col("cat_prob"))),
                         prep.category_map(p.rows))
    return d.select("doc_id", F.col("pred_category_id").cast("long"),
                    F.array_join("allowed", ",").alias("allowed"))


@register("f9_mask_to_zero", S.with_ctes(PREP, S.scores(coarse_cat=True), f"""
mk AS (SELECT s.doc_id, s.sub_prob, m.sub_ids
       FROM scores s LEFT JOIN cmap m
         ON m.category_id = list_position(s.cat_prob, list_max(s.cat_prob)) - 1),
masked AS (SELECT doc_id,
                  CASE WHEN sub_ids IS NULL OR len(sub_ids) = 0 THEN sub_prob
                       ELSE list_transform(range(len(sub_prob)), lambda j:
                              CASE WHEN list_contains(sub_ids, j) THEN sub_prob[j + 1] ELSE 0.0 END)
                  END AS mp
           FROM mk)""", body="""
SELECT doc_id, CAST(len(list_filter(mp, lambda x: x <> 0)) AS BIGINT) AS n_nonzero,
       round(list_sum(mp), 6) AS masked_sum,
       CAST(list_position(mp, list_max(mp)) - 1 AS BIGINT) AS masked_argmax
FROM masked"""))
def f9_mask_to_zero(spark, sf_dir):
    """the reference's mask-to-zero form (the argmax of the zeroed array may leave the
    allowed set when all allowed scores are 0; M5 does not)."""
    s, p = scores_val(spark, sf_dir, coarse=True)
    d = pd_.with_allowed(s.withColumn("pred_category_id", argmax(F.col("cat_prob"))),
                         prep.category_map(p.rows))
    mp = mask_to_zero(F.col("sub_prob"), F.col("allowed"))
    d = d.select("doc_id", mp.alias("mp"))
    return d.select("doc_id",
                    F.size(F.filter("mp", lambda x: x != 0)).cast("long").alias("n_nonzero"),
                    _r6(F.aggregate("mp", F.lit(0.0), lambda a, x: a + x)).alias("masked_sum"),
                    argmax(F.col("mp")).cast("long").alias("masked_argmax"))


@register("m5_masked_prediction", S.with_ctes(PREP, S.scores(coarse_cat=True), HIER_SQL, body="""
SELECT doc_id, CAST(pred_category_id AS BIGINT) AS pred_category_id,
       CAST(pred_subcategory_id AS BIGINT) AS pred_subcategory_id,
       round(category_confidence, 6) AS category_confidence,
       round(subcategory_confidence, 6) AS subcategory_confidence
FROM hier"""))
def m5_masked_prediction(spark, sf_dir):
    """M5: category argmax, then the best subcategory inside the allowed set."""
    s, p = scores_val(spark, sf_dir, coarse=True)
    h = pd_.hierarchical(s, prep.category_map(p.rows))
    return h.select("doc_id", F.col("pred_category_id").cast("long"),
                    F.col("pred_subcategory_id").cast("long"),
                    _r6(F.col("category_confidence")).alias("category_confidence"),
                    _r6(F.col("subcategory_confidence")).alias("subcategory_confidence"))


@register("m7_classify", S.with_ctes(PREP, S.scores(coarse_cat=True), HIER_SQL, body="""
SELECT h.doc_id, c.category, d.sub_category AS subcategory,
       round(h.category_confidence, 6) AS category_confidence,
       round(h.subcategory_confidence, 6) AS subcategory_confidence
FROM hier h JOIN cat_dict c ON c.category_id = h.pred_category_id
            JOIN sub_dict d ON d.subcategory_id = h.pred_subcategory_id"""))
def m7_classify(spark, sf_dir):
    """M7/M6: decoded category and subcategory with confidences."""
    s, p = scores_val(spark, sf_dir, coarse=True)
    out = pd_.classify(s, prep.category_map(p.rows), p.categories,
                       p.subcategories)
    return out.select("doc_id", "category", "subcategory",
                      _r6(F.col("category_confidence")).alias("category_confidence"),
                      _r6(F.col("subcategory_confidence")).alias("subcategory_confidence"))


@register("k4_top3", S.with_ctes(PREP, S.scores(coarse_cat=True), HIER_SQL, """
cat_c AS (SELECT doc_id, u.j, cat_prob[u.j + 1] AS score
          FROM scores, unnest(range(len(cat_prob))) AS u(j)),
top_c AS (SELECT * FROM (SELECT 'category' AS list, doc_id, j, score,
                                row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, j) AS rank
                         FROM cat_c) WHERE rank <= 3),
top_s AS (SELECT * FROM (SELECT 'subcategory' AS list, doc_id, j, score,
                                row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, j) AS rank
                         FROM cand WHERE score > 0) WHERE rank <= 3),
named AS (
  SELECT t.list, t.doc_id, t.rank, c.category AS label, t.score FROM top_c t
  JOIN cat_dict c ON c.category_id = t.j
  UNION ALL
  SELECT t.list, t.doc_id, t.rank, d.sub_category, t.score FROM top_s t
  JOIN sub_dict d ON d.subcategory_id = t.j)""", body="""
SELECT list, doc_id, CAST(rank AS BIGINT) AS rank, label, round(score, 6) AS confidence FROM named"""))
def k4_top3(spark, sf_dir):
    """K4 + P14: top-3 categories, and top-3 allowed subcategories with confidence > 0."""
    s, p = scores_val(spark, sf_dir, coarse=True)
    out = pd_.classify(s, prep.category_map(p.rows), p.categories,
                       p.subcategories, k=3)
    c = out.select("doc_id", F.posexplode("top_categories").alias("pos", "t")).select(
        F.lit("category").alias("list"), "doc_id", (F.col("pos") + 1).cast("long").alias("rank"),
        F.col("t.category").alias("label"), _r6(F.col("t.confidence")).alias("confidence"))
    s_ = out.select("doc_id", F.posexplode("top_subcategories").alias("pos", "t")).select(
        F.lit("subcategory").alias("list"), "doc_id", (F.col("pos") + 1).cast("long").alias("rank"),
        F.col("t.subcategory").alias("label"), _r6(F.col("t.confidence")).alias("confidence"))
    return c.unionByName(s_)


@register("j3_label_decoding", S.with_ctes(PREP, S.preds(), body="""
SELECT p.doc_id, c.category AS pred_category, d.sub_category AS pred_subcategory
FROM preds p JOIN cat_dict c ON c.category_id = p.pred_category_id
             JOIN sub_dict d ON d.subcategory_id = p.pred_subcategory_id"""))
def j3_label_decoding(spark, sf_dir):
    """Id -> name by joins with the label dictionaries."""
    d, p = preds_val(spark, sf_dir)
    d = prep.decode_labels(d, "pred_category_id", p.categories, "pred_category")
    d = prep.decode_labels(d, "pred_subcategory_id", p.subcategories, "pred_subcategory")
    return d.select("doc_id", "pred_category", "pred_subcategory")
