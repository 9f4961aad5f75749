"""Registered queries: training inputs (A10, J6, A23) and learned models (M2, M3, M4, M6,
M11), and the feature store they share (S5). Learned models are checked by invariants."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import Window, functions as F

from tiercat.operators import boosting as gb
from tiercat.operators import features as fe
from tiercat.operators import keywords as kw
from tiercat.operators import linear as ln
from tiercat.operators import metrics as mt
from tiercat.operators import predict as pd_
from tiercat.operators import prepare as prep
from tiercat.operators import tfidf
from tiercat.operators import train as tr
from tiercat.plans import fixtures as fx
from tiercat.plans import sql as S
from tiercat.plans.registry import register
from tiercat.session import materialize, scratch_path
from tiercat.sources.io import read_table

PREP = S.prepared_txn()
LEVELS = (("category", "category_id"), ("sub_category", "subcategory_id"))


def _r6(c):
    return F.round(c.cast("double"), 6)


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


@register("a10_class_weights", S.with_ctes(PREP, """
tr AS (SELECT * FROM prepared WHERE split = 'train')""", body="""
SELECT 'category' AS level, CAST(category_id AS BIGINT) AS class_id, count(*) AS n,
       round((SELECT count(*) FROM tr) / ((SELECT count(DISTINCT category_id) FROM tr) * count(*)), 6) AS weight
FROM tr GROUP BY category_id
UNION ALL
SELECT 'sub_category', subcategory_id, count(*),
       round((SELECT count(*) FROM tr) / ((SELECT count(DISTINCT subcategory_id) FROM tr) * count(*)), 6)
FROM tr GROUP BY subcategory_id"""))
def a10_class_weights(spark, sf_dir):
    t = fx.prepared_txn(spark, sf_dir).split("train")
    return _union([tr.class_weights(t, cls).select(
        F.lit(lvl).alias("level"), F.col(cls).cast("long").alias("class_id"),
        F.col("n").cast("long"), _r6(F.col("weight")).alias("weight")) for lvl, cls in LEVELS])


@register("j6_class_weight_join", S.with_ctes(PREP, """
tr AS (SELECT * FROM prepared WHERE split = 'train')""", body="""
SELECT doc_id, round((SELECT count(*) FROM tr) /
       ((SELECT count(DISTINCT subcategory_id) FROM tr) *
        count(*) OVER (PARTITION BY subcategory_id)), 6) AS weight
FROM tr"""))
def j6_class_weight_join(spark, sf_dir):
    t = fx.prepared_txn(spark, sf_dir).split("train")
    return tr.with_class_weights(t, "subcategory_id").select(
        "doc_id", _r6(F.col("weight")).alias("weight"))


@register("a23_distinct_train_labels", S.with_ctes(PREP, body="""
SELECT 'category' AS level, count(DISTINCT category_id) AS n_labels FROM prepared WHERE split = 'train'
UNION ALL
SELECT 'sub_category', count(DISTINCT subcategory_id) FROM prepared WHERE split = 'train'"""))
def a23_distinct_train_labels(spark, sf_dir):
    t = fx.prepared_txn(spark, sf_dir).split("train")
    return _union([tr.distinct_labels(t, cls).select(F.lit(lvl).alias("level"),
                                                     F.col("n_labels").cast("long"))
                   for lvl, cls in LEVELS])


# Learned models have no exact twin in SQL. Their oracles are computed from the prepared table and
# hold for any right model: exactly the validation rows, one probability per class, probabilities
# that sum to 1, and predictions among the classes.
_INVARIANT = """
SELECT '{lvl}' AS level, doc_id, CAST((SELECT count(*) FROM {d}) AS BIGINT) AS n_probs, 1.0 AS prob_sum,
       true AS known_class FROM prepared WHERE split = 'val'"""
INVARIANTS = S.with_ctes(PREP, body=_INVARIANT.format(lvl="category", d="cat_dict") + "\nUNION ALL"
                         + _INVARIANT.format(lvl="sub_category", d="sub_dict"))


def _validation(spark, sf_dir, what):
    data = fx.feature_table(spark, sf_dir) if what == "sparse" else \
        tr.dense_vectors(fx.dense_table(spark, sf_dir), "features")
    return data.where(F.col("split") == "val")


def _invariants(spark, sf_dir, family, what):
    val, out = _validation(spark, sf_dir, what), []
    for lvl, cls in LEVELS:
        scored = tr.probabilities(fx.models(spark, sf_dir, family, what)[cls], val)
        k = F.size("prob")
        out.append(scored.select(
            F.lit(lvl).alias("level"), "doc_id", k.cast("long").alias("n_probs"),
            _r6(F.aggregate("prob", F.lit(0.0), lambda a, x: a + x)).alias("prob_sum"),
            ((F.col("prediction") >= 0) & (F.col("prediction") < k)).alias("known_class")))
    return _union(out)


@register("s5_feature_store", S.with_ctes(PREP, S.tfidf(), body="""
SELECT p.doc_id, p.split, CAST(p.category_id AS BIGINT) AS category_id,
       CAST(p.subcategory_id AS BIGINT) AS subcategory_id, count(w.term) AS n_terms,
       CASE WHEN count(w.term) > 0 THEN 1.0 ELSE 0.0 END AS norm
FROM prepared p LEFT JOIN weights w ON w.doc_id = p.doc_id
GROUP BY ALL"""))
def s5_feature_store(spark, sf_dir):
    """The stored feature table; every prepared document has a row, empty vectors too."""
    return fx.feature_table(spark, sf_dir).select(
        "doc_id", "split", F.col("category_id").cast("long"), F.col("subcategory_id").cast("long"),
        F.col("n_terms").cast("long"), _r6(F.col("norm")).alias("norm"))


# Linear models besides: training stopped by itself, at the best of its epochs, and the category beats the
# majority.
STOPPED = S.with_ctes(PREP, body=f"""
SELECT *, true AS stopped_early, CASE WHEN level = 'category' THEN true END AS above_majority
FROM ({_INVARIANT.format(lvl="category", d="cat_dict")}
UNION ALL{_INVARIANT.format(lvl="sub_category", d="sub_dict")}) x""")


def _checked(scored, lvl, cls, **more):
    """The invariants of scored validation rows, and whether the category beats the majority."""
    k = F.size("prob")
    hits = scored.agg(F.avg((F.col("prediction") == F.col(cls)).cast("double"))).scalar()
    most = scored.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n") / F.sum("n")).scalar()
    return scored.select(
        F.lit(lvl).alias("level"), "doc_id", k.cast("long").alias("n_probs"),
        _r6(F.aggregate("prob", F.lit(0.0), lambda a, x: a + x)).alias("prob_sum"),
        ((F.col("prediction") >= 0) & (F.col("prediction") < k)).alias("known_class"),
        *[F.lit(v).alias(n) for n, v in more.items()],
        (hits > most if lvl == "category" else F.lit(None).cast("boolean")).alias("above_majority"))


def _linear(spark, sf_dir, loss):
    val, out = fx.feature_rows(spark, sf_dir, "val"), []
    for lvl, cls in LEVELS:
        m = fx.linear_models(spark, sf_dir, loss)[cls]
        scored = ln.probabilities(m, val.select("doc_id", cls, "indices", "values"))
        out.append(_checked(scored, lvl, cls, stopped_early=ln.PATIENCE < len(m.log) < ln.EPOCHS))
    return _union(out)


@register("m3_logreg_tfidf", STOPPED)
def m3_logreg_tfidf(spark, sf_dir):
    """M3 + M11: one-vs-all log loss (balanced weights) by SGD with early stopping on TF-IDF rows, both levels."""
    return _linear(spark, sf_dir, "log")


@register("m4_svc_tfidf", STOPPED)
def m4_svc_tfidf(spark, sf_dir):
    """M4: one-vs-all hinge loss (balanced weights) by SGD with early stopping on TF-IDF rows, both levels."""
    return _linear(spark, sf_dir, "hinge")


@register("m2_forest_dense", INVARIANTS)
def m2_forest_dense(spark, sf_dir):
    """M2: random forest (100 trees, depth 6) on text-vector ‖ type features, both levels."""
    return _invariants(spark, sf_dir, "forest", "dense")


# Boosting besides: the training loss falls with every round, and the category beats the majority.
BOOSTED = STOPPED.replace("stopped_early", "loss_falls")


@register("m2_boosting", BOOSTED)
def m2_boosting(spark, sf_dir):
    """M2: multiclass gradient boosting (rate 0.1, 12 rounds of depth 4) on text-vector ‖ type features, both
    levels."""
    val, out = fx.dense_table(spark, sf_dir).where(F.col("split") == "val"), []
    for lvl, cls in LEVELS:
        m = fx.boosters(spark, sf_dir)[cls]
        scored = gb.probabilities(m, val.select("features", "doc_id", cls))
        out.append(_checked(scored, lvl, cls, loss_falls=all(a > b for a, b in zip(m.losses, m.losses[1:]))))
    return _union(out)


@register("m4_svc_keywords", S.with_ctes(PREP, body="""
SELECT 'category' AS level, CAST(category_id AS BIGINT) AS class_id, true AS ranked FROM cat_dict
UNION ALL
SELECT 'sub_category', CAST(subcategory_id AS BIGINT), true FROM sub_dict"""))
def m4_svc_keywords(spark, sf_dir):
    """M4 -> M10: keywords mined from the SVM's learned weights, both levels; per class, whether its
    40 best and 40 worst terms were ranked by falling and rising weight."""
    f, presence, docs = fx.keyword_inputs(spark, sf_dir)
    supports, sizes = fx.supports(spark, sf_dir, presence, docs)
    out = []
    for lvl, cls in LEVELS:
        lw = fx.linear_models(spark, sf_dir, "hinge")[cls].weights() \
            .join(f.model.vocab.select("term", "term_idx"), "term_idx").select("class_id", "term", "weight")
        k = kw.keywords(lw, None, None, cls, 40, stats=kw.level_statistics(supports, sizes[cls], cls),
                        sizes=sizes[cls])
        best = kw.top_terms(lw, 40).groupBy("class_id").agg(
            F.count_if(F.col("direction") == "include").alias("n"),
            F.min(F.when(F.col("direction") == "include", F.col("weight"))).alias("low"),
            F.max(F.when(F.col("direction") == "exclude", F.col("weight"))).alias("high"))
        mined = k.groupBy("class_id").agg(F.count(F.lit(1)).alias("m"), F.max("rank").alias("r"))
        names = (fx.prepared_txn(spark, sf_dir).categories if cls == "category_id"
                 else fx.prepared_txn(spark, sf_dir).subcategories).select(F.col(cls).alias("class_id"))
        full = F.least(F.lit(40), F.lit(f.model.size))
        out.append(names.join(best, "class_id", "left").join(mined, "class_id", "left").select(
            F.lit(lvl).alias("level"), F.col("class_id").cast("long"),
            F.coalesce((F.col("n") == full) & (F.col("low") >= F.col("high"))
                       & (F.coalesce("m", F.lit(0)) <= 2 * full) & (F.coalesce("r", F.lit(1)) <= full),
                       F.lit(False)).alias("ranked")))
    return _union(out)


@register("m9_learned_report", S.with_ctes(PREP, body="""
SELECT 'category' AS level, count(*) AS n_val, true AS scores_in_range, true AS above_majority
FROM prepared WHERE split = 'val'
UNION ALL
SELECT 'sub_category', count(*), true, NULL FROM prepared WHERE split = 'val'"""))
def m9_learned_report(spark, sf_dir):
    """M9 on learned predictions (M3), per level: the report's support covers the validation split
    and its scores lie in [0, 1]. The category can be read from the text and beats the
    majority; the other level's second half (the source) cannot, so nothing is claimed there."""
    val, out = fx.feature_rows(spark, sf_dir, "val"), []
    for lvl, cls in LEVELS:
        m = fx.linear_models(spark, sf_dir, "log")[cls]
        scored = ln.probabilities(m, val.select("doc_id", cls, "indices", "values")) \
            .select(F.col(cls).alias("y"), F.col("prediction").cast("int").alias("p"))
        rep = mt.class_report(scored, "y", "p")
        e = rep.agg(
            F.sum("support").alias("n_val"), F.max("support").alias("most"), F.sum("tp").alias("tp"),
            F.min(F.least("precision", "recall", "f1")).alias("low"),
            F.max(F.greatest("precision", "recall", "f1")).alias("high"))
        above = (F.col("tp") > F.col("most")) if lvl == "category" else F.lit(None).cast("boolean")
        out.append(e.select(F.lit(lvl).alias("level"), F.col("n_val").cast("long"),
                            ((F.col("low") >= 0) & (F.col("high") <= 1)).alias("scores_in_range"),
                            above.alias("above_majority")))
    return _union(out)


@register("a15_learned_report", S.with_ctes(PREP, body="""
SELECT 'category' AS level, CAST(category_id AS BIGINT) AS label, count(*) AS support, true AS in_range
FROM prepared WHERE split = 'val' GROUP BY category_id
UNION ALL
SELECT 'sub_category', subcategory_id, count(*), true FROM prepared WHERE split = 'val' GROUP BY subcategory_id"""))
def a15_learned_report(spark, sf_dir):
    """A15 on learned predictions (M4): the report's row of every class of the validation split, and whether its
    scores lie in [0, 1] and fit its counts."""
    val, out = fx.feature_rows(spark, sf_dir, "val"), []
    for lvl, cls in LEVELS:
        m = fx.linear_models(spark, sf_dir, "hinge")[cls]
        scored = ln.probabilities(m, val.select("doc_id", cls, "indices", "values"))
        rep = mt.class_report(scored.select(F.col(cls).alias("y"), F.col("prediction").alias("p")), "y", "p")
        fits = (F.col("tp") <= F.least("support", "predicted")) & F.col("precision").between(0, 1) \
            & F.col("recall").between(0, 1) & F.col("f1").between(0, 1)
        out.append(rep.where("support > 0").select(
            F.lit(lvl).alias("level"), F.col("label").cast("long"), "support", fits.alias("in_range")))
    return _union(out)


@register("s6_persistence", S.with_ctes(PREP, S.tfidf(), body="""
SELECT term, round(idf, 6) AS idf, true AS same_models FROM vocab"""))
def s6_persistence(spark, sf_dir):
    """The vectorizer, a linear model of each level and a boosted one written and read back: the vocabulary as
    read, and whether the models read back predict what the written ones do."""
    path = scratch_path(spark, f"{spark.sparkContext.applicationId}/models-{uuid.uuid4().hex}")
    f = fx.text_features(spark, sf_dir)
    f.model.save(os.path.join(path, "vectorizer"))
    rows = fx.feature_rows(spark, sf_dir, "val")
    dense = fx.dense_table(spark, sf_dir).where(F.col("split") == "val").select("features", "doc_id")
    pairs = []
    for _, cls in LEVELS:
        m, at = fx.linear_models(spark, sf_dir, "hinge")[cls], os.path.join(path, cls)
        m.save(at)
        pairs.append([materialize(spark, ln.probabilities(x, rows.select("doc_id", "indices", "values")), "scored")
                      for x in (m, ln.load(spark, at))])
    m, at = fx.boosters(spark, sf_dir)["category_id"], os.path.join(path, "booster")
    m.save(spark, at)
    pairs.append([materialize(spark, gb.probabilities(x, dense), "scored") for x in (m, gb.load(spark, at))])
    same = [a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() for a, b in pairs]
    again = tfidf.load_model(spark, os.path.join(path, "vectorizer"))
    return again.vocab.select("term", _r6(F.col("idf")).alias("idf"), F.lit(all(same)).alias("same_models"))


@register("m1_learned_vectors", S.with_ctes(PREP, S.tfidf(), body="""
SELECT p.doc_id, 385 AS width, CASE WHEN count(w.term) > 0 THEN 1.0 ELSE 0.0 END AS norm,
       CASE any_value(p.type) WHEN ' Credit' THEN 1.0 WHEN 'DEBIT' THEN -1.0 ELSE 0.0 END AS type_value
FROM prepared p LEFT JOIN weights w ON w.doc_id = p.doc_id GROUP BY p.doc_id"""))
def m1_learned_vectors(spark, sf_dir):
    """M1 + P10: text vectors from the truncated SVD of the training rows, and the type feature behind them."""
    f = fx.text_features(spark, sf_dir)
    vec = fx.text_encoder(spark, sf_dir).encode(f.documents().select("doc_id", "indices", "tf", "norm"), idf=f.model.idf())
    types = fx.prepared_txn(spark, sf_dir).rows.select("doc_id", "type")
    d = vec.join(types, "doc_id").select("doc_id", "text_vec", fe.concat_type(F.col("text_vec"), F.col("type")).alias("f"))
    square = F.aggregate("text_vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return d.select("doc_id", F.size("f").alias("width"), F.round(F.sqrt(square), 5).alias("norm"),
                    F.element_at("f", -1).cast("double").alias("type_value"))


@register("m11_calibrated", S.with_ctes(PREP, body=_INVARIANT.format(lvl="category", d="cat_dict") + "\nUNION ALL"
                                        + _INVARIANT.format(lvl="sub_category", d="sub_dict")))
def m11_calibrated(spark, sf_dir):
    """M11 on hinge margins (M4): isotonic probabilities by class, fitted on the validation rows' margins; the
    invariants of the probabilities, and that every class's curve rises (``known_class`` is false else)."""
    val, out = fx.feature_rows(spark, sf_dir, "val"), []
    for lvl, cls in LEVELS:
        m = ln.calibrate(fx.linear_models(spark, sf_dir, "hinge")[cls], val, cls)
        rises = all(a[1] <= b[1] for s in m.steps for a, b in zip(s, s[1:]))
        scored = ln.probabilities(m, val.select("doc_id", "indices", "values"))
        k = F.size("prob")
        out.append(scored.select(
            F.lit(lvl).alias("level"), "doc_id", k.cast("long").alias("n_probs"),
            _r6(F.aggregate("prob", F.lit(0.0), lambda a, x: a + x)).alias("prob_sum"),
            ((F.col("prediction") >= 0) & (F.col("prediction") < k) & F.lit(rises)).alias("known_class")))
    return _union(out)


@register("w1_learned_terms", S.with_ctes(PREP, S.tfidf(), body="""
SELECT level, class_id, direction, CAST(least(40, (SELECT count(*) FROM vocab)) AS BIGINT) AS n, true AS in_order
FROM (SELECT 'category' AS level, CAST(category_id AS BIGINT) AS class_id FROM cat_dict
      UNION ALL SELECT 'sub_category', CAST(subcategory_id AS BIGINT) FROM sub_dict) c,
     (VALUES ('include'), ('exclude')) d(direction)"""))
def w1_learned_terms(spark, sf_dir):
    """W1 on learned weights (M4), read from their block table: the 40 best and worst terms of every class, and
    whether their ranks follow the weights."""
    vocab, out = fx.text_features(spark, sf_dir).model.vocab.select("term", "term_idx"), []
    for lvl, cls in LEVELS:
        w = fx.linear_models(spark, sf_dir, "hinge")[cls].weights().join(vocab, "term_idx").select(
            "class_id", "term", "weight")
        sign = F.when(F.col("direction") == "include", -1).otherwise(1)
        top = kw.top_terms(w, 40).withColumn("key", F.struct(sign * F.col("weight"), F.col("term")))
        before = F.lag("key").over(Window.partitionBy("class_id", "direction").orderBy("rank"))
        out.append(top.withColumn("ok", F.coalesce(before < F.col("key"), F.lit(True))).groupBy("class_id", "direction").agg(
            F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("in_order")).select(
            F.lit(lvl).alias("level"), F.col("class_id").cast("long"), "direction", "n", "in_order"))
    return _union(out)


@register("m6_batch_scoring", S.with_ctes(PREP, body="""
SELECT doc_id, true AS known_category, true AS allowed_subcategory, true AS confidences
FROM prepared WHERE split = 'val'"""))
def m6_batch_scoring(spark, sf_dir):
    """M6: two dense logistic-regression models, hierarchical masking, decoded labels; whether the
    category is known, the subcategory is allowed under it, and both confidences are
    probabilities."""
    p = fx.prepared_txn(spark, sf_dir)
    m = fx.models(spark, sf_dir, "logreg", "dense")
    val = _validation(spark, sf_dir, "dense").select("doc_id", "features")
    s = tr.probabilities(m["category_id"], val, "cat_prob").drop("prediction")
    s = tr.probabilities(m["subcategory_id"], s, "sub_prob").drop("prediction")
    out = pd_.classify(s, prep.category_map(p.rows), p.categories,
                       p.subcategories, k=3)
    pairs = p.rows.select("category", F.col("sub_category").alias("subcategory")).distinct() \
        .withColumn("allowed_pair", F.lit(True))
    ok = lambda c: F.col(c).between(0, 1) & (F.col(c) > 0)
    return out.join(pairs, ["category", "subcategory"], "left").select(
        "doc_id", F.col("category").isNotNull().alias("known_category"),
        F.coalesce("allowed_pair", F.lit(False)).alias("allowed_subcategory"),
        (ok("category_confidence") & ok("subcategory_confidence")).alias("confidences"))


@register("m11_predict_proba", """
SELECT vec_id, CAST((SELECT count(DISTINCT label) FROM embeddings) AS BIGINT) AS n_probs,
       1.0 AS prob_sum
FROM embeddings""")
def m11_predict_proba(spark, sf_dir):
    """M11 invariants on any model: one probability per class, summing to 1 (logistic
    regression on the 64-wide embeddings ‖ type feature)."""
    e = read_table(spark, sf_dir, "embeddings")
    t = F.when(F.col("vec_id") % 3 == 0, F.lit("credit")).when(F.col("vec_id") % 3 == 1,
                                                                F.lit("DEBIT"))
    d = e.select("vec_id", "label", fe.concat_type(F.col("embedding"), t).alias("features"))
    d = tr.dense_vectors(d, "features")
    model = tr.fit(d, "logreg", "label")
    s = tr.probabilities(model, d)
    return s.select("vec_id", F.size("prob").cast("long").alias("n_probs"),
                    _r6(F.aggregate("prob", F.lit(0.0), lambda a, x: a + x)).alias("prob_sum"))
