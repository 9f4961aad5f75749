"""Registered queries: evaluation metrics on deterministic predictions and probabilities
(A14-A20, U1, K2, P13, M9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tiercat.operators import metrics as mt
from tiercat.operators import predict as pd_
from tiercat.operators import prepare as prep
from tiercat.plans import fixtures as fx
from tiercat.plans import sql as S
from tiercat.plans.registry import register

PREP = S.prepared_txn()
LEVELS = (("category", "category_id", "pred_category_id"),
          ("sub_category", "subcategory_id", "pred_subcategory_id"))


def _r6(c):
    return F.round(c.cast("double"), 6)


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def preds_val(spark, sf_dir):
    p = fx.prepared_txn(spark, sf_dir)
    k_cat, k_sub = fx.class_count(p.categories), fx.class_count(p.subcategories)
    return fx.with_predictions(p.split("val"), k_cat, k_sub), p


def scores_val(spark, sf_dir, coarse=False):
    p = fx.prepared_txn(spark, sf_dir)
    k_cat, k_sub = fx.class_count(p.categories), fx.class_count(p.subcategories)
    return fx.with_scores(p.split("val"), k_cat, k_sub, coarse), p


@register("a14_accuracy", S.with_ctes(PREP, S.preds(), body="""
SELECT 'category' AS level, round(avg(CASE WHEN category_id = pred_category_id THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds
UNION ALL
SELECT 'sub_category', round(avg(CASE WHEN subcategory_id = pred_subcategory_id THEN 1.0 ELSE 0.0 END), 6) FROM preds"""))
def a14_accuracy(spark, sf_dir):
    d, _ = preds_val(spark, sf_dir)
    return _union([mt.accuracy(d, y, p).select(F.lit(lvl).alias("level"),
                                               _r6(F.col("accuracy")).alias("accuracy"))
                   for lvl, y, p in LEVELS])


@register("a15_class_report", S.with_ctes(
    PREP, S.preds(), S.report("preds", "category_id", "pred_category_id", "rc"),
    S.report("preds", "subcategory_id", "pred_subcategory_id", "rs"), body="""
SELECT 'category' AS level, CAST(label AS BIGINT) AS label, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rc
UNION ALL
SELECT 'sub_category', label, round(precision, 6), round(recall, 6), round(f1, 6), support FROM rs"""))
def a15_class_report(spark, sf_dir):
    """A15 + U1: per-class precision, recall, F1 and support over truth ∪ prediction."""
    d, _ = preds_val(spark, sf_dir)
    return _union([mt.class_report(d, y, p).select(
        F.lit(lvl).alias("level"), F.col("label").cast("long"),
        _r6(F.col("precision")).alias("precision"), _r6(F.col("recall")).alias("recall"),
        _r6(F.col("f1")).alias("f1"), "support") for lvl, y, p in LEVELS])


@register("u1_report_labels", S.with_ctes(PREP, S.preds(), body="""
SELECT 'sub_category' AS level, CAST(subcategory_id AS BIGINT) AS label FROM preds
UNION SELECT 'sub_category', pred_subcategory_id FROM preds
UNION SELECT 'category', category_id FROM preds
UNION SELECT 'category', pred_category_id FROM preds"""))
def u1_report_labels(spark, sf_dir):
    """Report classes = labels seen in truth or in prediction."""
    d, _ = preds_val(spark, sf_dir)
    return _union([d.select(F.lit(lvl).alias("level"), F.col(c).cast("long").alias("label"))
                   for lvl, y, p in LEVELS for c in (y, p)]).distinct()


_SUMMARY_SQL = """
SELECT '{lvl}' AS level, round(avg(precision), 6) AS precision_macro,
       round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
       round(sum(tp) / sum(support), 6) AS accuracy
FROM {rep}"""


@register("m9_evaluation", S.with_ctes(
    PREP, S.preds(), S.report("preds", "category_id", "pred_category_id", "rc"),
    S.report("preds", "subcategory_id", "pred_subcategory_id", "rs"),
    body=_SUMMARY_SQL.format(lvl="category", rep="rc") + "\nUNION ALL" +
    _SUMMARY_SQL.format(lvl="sub_category", rep="rs")))
def m9_evaluation(spark, sf_dir):
    """M9 (+A16, A17): accuracy, macro precision/recall/F1 and weighted F1 per level."""
    d, _ = preds_val(spark, sf_dir)
    return _union([mt.evaluation(d, y, p).select(
        F.lit(lvl).alias("level"), *[_r6(F.col(c)).alias(c) for c in
                                     ("precision_macro", "recall_macro", "f1_macro",
                                      "f1_weighted", "accuracy")])
        for lvl, y, p in LEVELS])


_REPORTS = (S.report("preds", "category_id", "pred_category_id", "rc"),
            S.report("preds", "subcategory_id", "pred_subcategory_id", "rs"))


@register("a16_macro_averages", S.with_ctes(PREP, S.preds(), *_REPORTS, body="\nUNION ALL".join(f"""
SELECT '{lvl}' AS level, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro,
       round(avg(f1), 6) AS f1_macro FROM {rep}""" for lvl, rep in (("category", "rc"), ("sub_category", "rs")))))
def a16_macro_averages(spark, sf_dir):
    d, _ = preds_val(spark, sf_dir)
    return _union([mt.summary(mt.class_report(d, y, p)).select(
        F.lit(lvl).alias("level"), *[_r6(F.col(c)).alias(c) for c in ("precision_macro", "recall_macro", "f1_macro")])
        for lvl, y, p in LEVELS])


@register("a17_weighted_f1", S.with_ctes(PREP, S.preds(), *_REPORTS, body="\nUNION ALL".join(f"""
SELECT '{lvl}' AS level, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM {rep}"""
    for lvl, rep in (("category", "rc"), ("sub_category", "rs")))))
def a17_weighted_f1(spark, sf_dir):
    d, _ = preds_val(spark, sf_dir)
    return _union([mt.summary(mt.class_report(d, y, p)).select(
        F.lit(lvl).alias("level"), _r6(F.col("f1_weighted")).alias("f1_weighted")) for lvl, y, p in LEVELS])


@register("a18_joint_accuracy", S.with_ctes(PREP, S.preds(), body="""
SELECT round(avg(CASE WHEN category_id = pred_category_id AND subcategory_id = pred_subcategory_id
                      THEN 1.0 ELSE 0.0 END), 6) AS joint_accuracy FROM preds"""))
def a18_joint_accuracy(spark, sf_dir):
    d, _ = preds_val(spark, sf_dir)
    j = mt.joint_accuracy(d, "category_id", "pred_category_id", "subcategory_id",
                          "pred_subcategory_id")
    return j.select(_r6(F.col("joint_accuracy")).alias("joint_accuracy"))


# masked prediction in the oracle: rank allowed candidates by (score desc, index asc)
HIER_SQL = """
catpred AS (
  SELECT s.*, CAST(list_position(cat_prob, list_max(cat_prob)) - 1 AS INTEGER) AS pred_category_id
  FROM scores s),
cand AS (
  SELECT c.doc_id, u.j, c.sub_prob[u.j + 1] AS score
  FROM catpred c LEFT JOIN cmap m ON m.category_id = c.pred_category_id,
       unnest(range(len(c.sub_prob))) AS u(j)
  WHERE m.sub_ids IS NULL OR len(m.sub_ids) = 0 OR list_contains(m.sub_ids, u.j)),
best AS (
  SELECT doc_id, j AS pred_subcategory_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, j) AS r FROM cand)
  WHERE r = 1),
hier AS (
  SELECT c.doc_id, c.category_id, c.subcategory_id, c.pred_category_id,
         CAST(b.pred_subcategory_id AS INTEGER) AS pred_subcategory_id,
         c.cat_prob[c.pred_category_id + 1] AS category_confidence,
         b.score AS subcategory_confidence
  FROM catpred c JOIN best b USING (doc_id))"""


@register("a19_hierarchical_accuracy", S.with_ctes(PREP, S.scores(), HIER_SQL, body="""
SELECT round(avg(CASE WHEN category_id = pred_category_id AND subcategory_id = pred_subcategory_id
                      THEN 1.0 ELSE 0.0 END), 6) AS hierarchical_accuracy FROM hier"""))
def a19_hierarchical_accuracy(spark, sf_dir):
    """Joint accuracy after masking the subcategory by the predicted category."""
    s, p = scores_val(spark, sf_dir)
    h = pd_.hierarchical(s, prep.category_map(p.rows))
    j = mt.joint_accuracy(h, "category_id", "pred_category_id", "subcategory_id",
                          "pred_subcategory_id")
    return j.select(_r6(F.col("joint_accuracy")).alias("hierarchical_accuracy"))


@register("a20_confidence_summary", S.with_ctes(PREP, S.scores(), body="""
SELECT 'category' AS level, round(avg(c), 6) AS mean, round(median(c), 6) AS median,
       round(min(c), 6) AS min, round(max(c), 6) AS max
FROM (SELECT list_max(cat_prob) AS c FROM scores)
UNION ALL
SELECT 'sub_category', round(avg(c), 6), round(median(c), 6), round(min(c), 6), round(max(c), 6)
FROM (SELECT list_max(sub_prob) AS c FROM scores)"""))
def a20_confidence_summary(spark, sf_dir):
    """A20 + F10: confidence = maximum probability per row; summary per level."""
    s, _ = scores_val(spark, sf_dir)
    return _union([mt.confidence_summary(s, col).select(
        F.lit(lvl).alias("level"), *[_r6(F.col(c)).alias(c) for c in ("mean", "median", "min", "max")])
        for lvl, col in (("category", "cat_prob"), ("sub_category", "sub_prob"))])


@register("p13_low_confidence", S.with_ctes(PREP, S.scores(coarse_cat=True), body="""
SELECT 'category' AS level, count(*) FILTER (WHERE list_max(cat_prob) < 0.5) AS n_low,
       round(100.0 * count(*) FILTER (WHERE list_max(cat_prob) < 0.5) / count(*), 6) AS pct_low
FROM scores
UNION ALL
SELECT 'sub_category', count(*) FILTER (WHERE list_max(sub_prob) < 0.5),
       round(100.0 * count(*) FILTER (WHERE list_max(sub_prob) < 0.5) / count(*), 6)
FROM scores"""))
def p13_low_confidence(spark, sf_dir):
    s, _ = scores_val(spark, sf_dir, coarse=True)
    return _union([mt.low_confidence(s, col, 0.5).select(
        F.lit(lvl).alias("level"), "n_low", _r6(F.col("pct_low")).alias("pct_low"))
        for lvl, col in (("category", "cat_prob"), ("sub_category", "sub_prob"))])


K2_NAMED = """named AS (SELECT d.sub_category AS name, round(r.f1, 6) AS f1, r.f1 AS f1_raw, r.support
           FROM rs r JOIN sub_dict d ON d.subcategory_id = r.label)"""


@register("k2_f1_extremes", S.with_ctes(
    PREP, S.preds(), S.report("preds", "subcategory_id", "pred_subcategory_id", "rs"), K2_NAMED,
    body="""
SELECT * FROM (SELECT 'top' AS which, name, f1, support,
                      row_number() OVER (ORDER BY f1_raw DESC, name) AS rank FROM named)
WHERE rank <= 10
UNION ALL
SELECT * FROM (SELECT 'bottom' AS which, name, f1, support,
                      row_number() OVER (ORDER BY f1_raw ASC, name DESC) AS rank FROM named)
WHERE rank <= 10"""))
def k2_f1_extremes(spark, sf_dir):
    """K2: top and bottom 10 subcategories by F1, with support, decoded to names."""
    d, p = preds_val(spark, sf_dir)
    rep = mt.class_report(d, "subcategory_id", "pred_subcategory_id")
    named = prep.decode_labels(rep.withColumnRenamed("label", "subcategory_id"),
                               "subcategory_id", p.subcategories, "name")
    ext = mt.f1_extremes(named, "name", 10)
    return ext.select("which", "name", _r6(F.col("f1")).alias("f1"),
                      F.col("support").cast("long"), F.col("rank").cast("long"))
