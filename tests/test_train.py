"""Training inputs and learned models: invariants only (models are not reproducible)."""

from pyspark.sql import functions as F

from tiercat.operators import train as tr
from tiercat.plans import fixtures as fx
from tiercat.plans.classifier import HierarchicalClassifier

from folders import SF_MID


def test_balanced_weights_sum_to_n(spark):
    df = spark.createDataFrame([(i % 5 if i % 3 else 0,) for i in range(200)], "y int")
    w = tr.class_weights(df, "y").collect()
    assert abs(sum(r.n * r.weight for r in w) - 200) < 1e-9


def test_hierarchical_classifier_end_to_end(spark, tmp_path):
    p = fx.prepare(fx.txn(spark, SF_MID), 10)
    train = p.split("train").cache()
    model = HierarchicalClassifier.fit(train, p.categories, p.subcategories, "logreg",
                                       max_iter=30)
    val = p.split("val")
    out = model.transform(val, top_k=3).cache()
    assert out.count() == val.count()
    # every predicted subcategory is allowed under the predicted category
    cmap = {r.category_id: set(r.sub_ids) for r in model.cmap.collect()}
    for r in out.select("pred_category_id", "pred_subcategory_id", "top_subcategories").collect():
        assert r.pred_subcategory_id in cmap[r.pred_category_id]
        assert len(r.top_subcategories) <= 3
    # category = language: the model must beat the majority-class rate
    acc = out.agg(F.avg((F.col("pred_category_id") == F.col("category_id"))
                        .cast("double"))).first()[0]
    majority = (val.groupBy("category_id").count().agg(F.max("count")).first()[0]
                / val.count())
    assert acc > majority
    path = str(tmp_path / "model")
    model.save(path)
    again = HierarchicalClassifier.load(spark, path)
    a = {r.doc_id: r.subcategory for r in model.transform(val).select("doc_id", "subcategory").collect()}
    b = {r.doc_id: r.subcategory for r in again.transform(val).select("doc_id", "subcategory").collect()}
    assert a == b


def test_feature_table_keeps_every_document(spark, tmp_path):
    docs = spark.createDataFrame([(1, 0, "train"), (2, 1, "train"), (3, 0, "val")], "doc_id long, y int, split string")
    w = spark.createDataFrame([(1, 4, 0.6), (1, 2, 0.8), (3, 0, 1.0)], "doc_id long, term_idx int, weight double")
    t = tr.feature_table(docs, w, "doc_id", 6, str(tmp_path / "f"))
    rows = {r.doc_id: r for r in t.collect()}
    assert set(rows) == {1, 2, 3} and rows[2].features.toArray().tolist() == [0.0] * 6
    assert rows[1].features.toArray().tolist() == [0, 0, 0.8, 0, 0.6, 0] and rows[1].n_terms == 2
    assert abs(rows[1].norm - 1) < 1e-12
    assert t.where("split = 'val'").count() == 1


def test_softmax_is_linear_and_sums_to_one(spark):
    from tiercat.functions.arrays import l2_normalize, softmax
    d = spark.range(50).select(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: (i % 7).cast("double")).alias("v"))
    s = d.select(F.aggregate(softmax(F.col("v")), F.lit(0.0), lambda a, x: a + x).alias("s"),
                 F.aggregate(l2_normalize(F.col("v")), F.lit(0.0), lambda a, x: a + x * x).alias("n")).collect()
    assert all(abs(r.s - 1) < 1e-9 and abs(r.n - 1) < 1e-9 for r in s)


def test_boosting_and_hinge_give_probabilities(spark):
    d = spark.range(90).select((F.col("id") % 3).cast("int").alias("y"), F.array(
        (F.col("id") % 3).cast("float"), (F.col("id") % 7).cast("float")).alias("features"))
    d = tr.dense_vectors(d)
    for family in ("gbt_ovr", "svc_ovr"):
        m = tr.fit(d, family, "y", max_iter=3)
        r = tr.probabilities(m, d).collect()
        assert all(len(x.prob) == 3 and abs(sum(x.prob) - 1) < 1e-9 for x in r)
        if family == "gbt_ovr":
            assert sum(x.prediction == x.y for x in r) == 90


def test_vectorizer_round_trip(spark, tmp_path):
    from tiercat.operators import tfidf
    docs = spark.createDataFrame([(i, f"common word{i % 3} text") for i in range(12)], "k long, t string")
    tf = tfidf.term_frequencies(docs, "k", "t").cache()
    m = tfidf.fit(tf, 12, min_df=2)
    m.save(str(tmp_path / "v"))
    again = tfidf.load_model(spark, str(tmp_path / "v"))
    a, b = (sorted(tuple(r) for r in x.weights(tf, "k").collect()) for x in (m, again))
    assert a == b and again.size == m.size


def test_a_fit_reads_bounded_partitions(spark, monkeypatch):
    d = tr.dense_vectors(spark.range(400).coalesce(1).select(
        F.array(F.col("id") % 2 * 1.0, F.rand(1)).alias("features"), (F.col("id") % 2).cast("int").alias("y")))
    seen = []
    monkeypatch.setattr(tr, "Pipeline", lambda stages: type("P", (), {"fit": lambda self, data: seen.append(
        (data.rdd.getNumPartitions(), data.count()))})())
    monkeypatch.setattr(tr, "ROWS_A_TASK", 50)
    tr.fit(d, "logreg", "y")
    assert seen == [(8, 400)]


def test_dense_logreg_has_the_same_optimum_without_zeros(spark, monkeypatch):
    d = tr.dense_vectors(spark.range(600).select(
        (F.col("id") % 3).cast("int").alias("y"), F.array(
            F.when(F.rand(1) < .6, 0.0).otherwise(F.rand(2) + F.col("id") % 3), F.when(F.rand(3) < .7, 0.0).otherwise(F.rand(4) * 5),
            F.lit(2.0), F.col("id") % 2 * F.rand(5)).alias("features"))).cache()
    seen, estimator = [], tr.estimator
    monkeypatch.setattr(tr, "estimator", lambda family, label, features, *a: seen.append(features) or estimator(family, label, features, *a))
    plain, dense = tr.fit(d, "logreg", "y"), tr.fit(d, "logreg", "y", dense=True)
    a, b = ({r.features: r.prob for r in tr.probabilities(m, d).collect()} for m in (plain, dense))
    assert seen == ["features", tr.SCALED] and "_scaled" not in tr.probabilities(dense, d).columns
    assert all(abs(x - y) < 1e-4 for k in a for x, y in zip(a[k], b[k]))
    # the long weights are by the features as given
    w, v = ({(r.class_id, r.term_idx): r.weight for r in tr.linear_weights(spark, m).collect()} for m in (plain, dense))
    assert len(w) == 12 and all(abs(w[k] - v[k]) < 1e-3 for k in w)


def test_the_feature_join_sorts_bounded_partitions(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(0).alias("y"))
    terms = F.array(F.struct(F.lit(1).alias("term_idx"), F.lit(1.0).alias("weight"))).alias("terms")
    rows = spark.range(0, 300, 2).select(F.col("id").alias("doc_id"), terms)
    t = tr.feature_table(docs, rows, "doc_id", 3, str(tmp_path / "f"), partitions=23)
    assert len(list((tmp_path / "f").glob("part-*"))) == 23
    assert {r.doc_id: r.n_terms for r in t.collect()} == {i: 1 - i % 2 for i in range(300)}
