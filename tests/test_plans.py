"""Plan shapes that the scale design relies on (read from explain output)."""

import contextlib
import io

from pyspark.sql import functions as F

from tiercat.operators import keywords as kw
from tiercat.operators import tfidf
from tiercat.plans import fixtures as fx
from tiercat.session import materialize_bucketed

from folders import SF_SMALL


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_tf_stage_has_one_exchange(spark):
    docs = fx.txn(spark, SF_SMALL).select("doc_id", "clean_description")
    tf = tfidf.term_frequencies(docs, "doc_id", "clean_description")
    p = plan(tf)
    # the repartition by key; counting (doc, term) reuses that partitioning
    assert p.count("Exchange hashpartitioning") == 1
    assert "FileScan parquet" in p and "n_chars" not in p.split("FileScan parquet")[1].split("\n")[0]


def test_preparation_pass_two_reads_the_text_once(spark):
    p = fx.prepare(fx.txn(spark, SF_SMALL, with_type=False), 2)
    text = plan(p.rows)
    # the dictionary is a small written table, so the planner broadcasts it by its size
    assert "BroadcastHashJoin" in text
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text and "Window" not in text
    assert text.count("documents.parquet") == 1 and "Exchange hashpartitioning" not in text


def test_profile_reads_documents_once_and_no_labels(spark):
    from tiercat.plans import registry
    for name in ("a1_value_counts", "a3_distinct_classes", "a5_count_stats", "a7_imbalance_ratio",
                 "k1_top_bottom_classes", "k3_sorted_labels"):
        text = plan(registry.queries()[name](spark, SF_SMALL))
        assert text.count("FileScan parquet") == 1 and "labels.parquet" not in text, name
    assert "NestedLoop" not in plan(registry.queries()["p6_text_sample"](spark, SF_SMALL))


def test_no_python_in_scoring_of_sparse_models(spark):
    f = fx.feature_table(spark, SF_SMALL)
    assert "Python" not in plan(f) and "Arrow" not in plan(f)


def test_top_terms_limits_groups_before_shuffle(spark):
    w = spark.range(2000).select((F.col("id") % 7).cast("int").alias("class_id"),
                                 F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"),
                                 (F.col("id") * 37 % 101).cast("double").alias("weight"))
    assert "WindowGroupLimit" in plan(kw.top_terms(w, 5))


def test_no_exchange_by_document_behind_the_vocabulary(spark, monkeypatch):
    f = fx.text_features(spark, SF_SMALL, min_df=2)
    for d in (f.weights("train"), f.model.rows(f.tf, "doc_id"), f.model.presence(f.tf)):
        text = plan(d)
        # the vocabulary is a small written table, so the planner broadcasts it
        assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "Window" not in text
    with monkeypatch.context() as m:
        m.setattr(tfidf, "BROADCAST_BYTES", 0)
        assert sorted(map(tuple, f.weights("val").collect())) == sorted(map(tuple, fx.text_features(
            spark, SF_SMALL, min_df=2).model.weights(f.tf.where("split = 'val'"), "doc_id").collect()))


def test_the_sketch_passes_every_frequent_term(spark):
    docs = spark.createDataFrame([(i, f"common w{i % 30} rare{i} {'often' if i % 3 else ''}") for i in range(300)],
                                 "k long, t string")
    tf = tfidf.term_frequencies(docs, "k", "t").cache()
    exact = {r.term: r.df for r in tfidf.document_frequencies(tf).collect()}
    for bits in (24, 12):
        passed = {r.term for r in tf.where(tfidf.maybe_frequent(tf, 10, bits)).select("term").distinct().collect()}
        assert {t for t, n in exact.items() if n >= 10} <= passed
    assert len(passed) < len(exact) / 3
    assert tf.where("false").where(tfidf.maybe_frequent(tf.where("false"), 10)).count() == 0


def test_text_a_task_counts_is_bounded(spark):
    docs = spark.range(40).select(F.col("id").alias("k"), F.repeat(F.lit("x y "), 250).alias("t"))  # 40,000 bytes
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tfidf.text_partitions(docs, "t") == least and tfidf.text_partitions(docs.where("false"), "t") == least
    n = tfidf.text_partitions(docs, "t", 1000)
    assert n == 40
    table = materialize_bucketed(spark, tfidf.term_frequencies(docs, "k", "t", partitions=n), "k", "bounded", n)
    # adaptive execution must not put them together again, and the buckets must not be dealt once more
    assert table.count() == 160 and len(table.inputFiles()) > least
    assert f"{n} out of {n}" in plan(table.groupBy("k").count())
