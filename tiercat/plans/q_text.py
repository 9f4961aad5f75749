"""Registered queries: text analysis and TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiercat.functions import text as tx
from tiercat.plans import fixtures as fx
from tiercat.plans import sql as S
from tiercat.plans.registry import register

NORM_SQL = "strip_accents(lower(clean_description))"
TOKS_SQL = f"regexp_extract_all({NORM_SQL}, '{S.TOKEN_RE}')"


def _r6(c):
    return F.round(c.cast("double"), 6)


@register("f4_normalize_text", S.with_ctes(S.TXN, body=f"""
SELECT doc_id, md5({NORM_SQL}) AS norm_md5, CAST(length({NORM_SQL}) AS BIGINT) AS n_chars
FROM txn"""))
def f4_normalize_text(spark, sf_dir):
    """F1 + F4: lower-case then strip accents (checked through an md5 of the whole text)."""
    n = tx.normalize_text(F.col("clean_description"))
    return fx.txn(spark, sf_dir).select("doc_id", F.md5(n).alias("norm_md5"),
                                        F.length(n).cast("long").alias("n_chars"))


@register("f5_tokens", S.with_ctes(S.TXN, body=f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {TOKS_SQL} AS t FROM txn)"""))
def f5_tokens(spark, sf_dir):
    t = tx.tokens(tx.normalize_text(F.col("clean_description")))
    return fx.txn(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"),
                                        F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@register("f6_ngrams", S.with_ctes(S.TXN, body=f"""
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_grams, md5(array_to_string(g, '|')) AS grams_md5
FROM (SELECT doc_id, list_concat(t, list_transform(range(greatest(len(t) - 1, 0)),
                                                   lambda i: t[i + 1] || ' ' || t[i + 2])) AS g
      FROM (SELECT doc_id, {TOKS_SQL} AS t FROM txn))"""))
def f6_ngrams(spark, sf_dir):
    # tokens, then n-grams, each one projected column, so a text is tokenised once
    t = fx.txn(spark, sf_dir, with_type=False).select(
        "doc_id", tx.tokens(tx.normalize_text(F.col("clean_description"))).alias("toks"))
    g = t.select("doc_id", tx.word_ngrams(F.col("toks"), 1, 2).alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("n_grams"),
                    F.md5(F.array_join("g", "|")).alias("grams_md5"))


_TFIDF = S.with_ctes  # alias for readability below


@register("a11_vocabulary", _TFIDF(S.prepared_txn(), S.tfidf(), body="""
SELECT term, df, CAST(total AS BIGINT) AS total FROM vocab"""))
def a11_vocabulary(spark, sf_dir):
    v = fx.text_features(spark, sf_dir).model.vocab
    return v.select("term", F.col("df").cast("long"), F.col("total").cast("long"))


@register("a12_idf", _TFIDF(S.prepared_txn(), S.tfidf(), body="""
SELECT term, round(idf, 6) AS idf FROM vocab"""))
def a12_idf(spark, sf_dir):
    v = fx.text_features(spark, sf_dir).model.vocab
    return v.select("term", _r6(F.col("idf")).alias("idf"))


@register("f7_sublinear_tf", _TFIDF(S.prepared_txn(), S.tfidf(), body="""
SELECT doc_id, term, tf, round(1 + ln(tf), 6) AS sublinear_tf
FROM tf WHERE split = 'train' AND term IN (SELECT term FROM vocab)"""))
def f7_sublinear_tf(spark, sf_dir):
    f = fx.text_features(spark, sf_dir)
    p = f.model.presence(f.rows.where(F.col("split") == "train"))
    return p.select("doc_id", "term", F.col("tf").cast("long"),
                    _r6(tx.sublinear_tf(F.col("tf"))).alias("sublinear_tf"))


@register("f8_tfidf_weights", _TFIDF(S.prepared_txn(), S.tfidf(), body="""
SELECT doc_id, term, round(weight, 6) AS weight FROM weights WHERE split = 'train'"""))
def f8_tfidf_weights(spark, sf_dir):
    w = fx.text_features(spark, sf_dir).weights("train")
    return w.select("doc_id", "term", _r6(F.col("weight")).alias("weight"))


@register("m8_tfidf_transform_val", _TFIDF(S.prepared_txn(), S.tfidf(), body="""
SELECT doc_id, term, round(weight, 6) AS weight FROM weights WHERE split = 'val'"""))
def m8_tfidf_transform_val(spark, sf_dir):
    """M8: validation documents weighted with the vocabulary and idf fitted on train."""
    w = fx.text_features(spark, sf_dir).weights("val")
    return w.select("doc_id", "term", _r6(F.col("weight")).alias("weight"))


@register("p15_presence", _TFIDF(S.prepared_txn(), S.tfidf(), body="""
SELECT doc_id, count(*) AS n_terms FROM tf
WHERE split = 'train' AND term IN (SELECT term FROM vocab) GROUP BY doc_id"""))
def p15_presence(spark, sf_dir):
    """Distinct in-vocabulary terms per training document (presence, not weight)."""
    f = fx.text_features(spark, sf_dir)
    p = f.model.presence(f.rows.where(F.col("split") == "train"))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"))
