"""Registered queries: dense features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiercat.functions.text import type_feature
from tiercat.operators import features as fe
from tiercat.plans import fixtures as fx
from tiercat.plans import sql as S
from tiercat.plans.registry import register
from tiercat.sources.io import read_table

EMB_TYPE_SQL = """emb AS (
  SELECT vec_id, embedding,
         CASE vec_id % 3 WHEN 0 THEN 'credit' WHEN 1 THEN 'DEBIT' END AS type
  FROM embeddings)"""
TYPE_FEATURE_SQL = """CASE WHEN type IS NULL THEN 0.0
            WHEN contains(lower(type), 'credit') THEN 1.0
            WHEN contains(lower(type), 'debit') THEN -1.0 ELSE 0.0 END"""


def _emb(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    t = (F.when(F.col("vec_id") % 3 == 0, F.lit("credit"))
         .when(F.col("vec_id") % 3 == 1, F.lit("DEBIT")))
    return e.withColumn("type", t)


def _long(df, key, arr):
    return df.select(key, F.posexplode(arr).alias("pos", "value")).select(
        key, F.col("pos").cast("long"), F.round(F.col("value").cast("double"), 6).alias("value"))


@register("p9_type_encoding", S.with_ctes(S.TXN, body=f"""
SELECT doc_id, type, {TYPE_FEATURE_SQL} AS type_feature FROM txn"""))
def p9_type_encoding(spark, sf_dir):
    return fx.txn(spark, sf_dir).select("doc_id", "type",
                                        type_feature(F.col("type")).alias("type_feature"))


@register("p10_feature_concat", S.with_ctes(EMB_TYPE_SQL, body=f"""
SELECT vec_id, CAST(u.pos AS BIGINT) AS pos, round(CAST(v[u.pos + 1] AS DOUBLE), 6) AS value
FROM (SELECT vec_id, list_concat(embedding, [CAST({TYPE_FEATURE_SQL} AS FLOAT)]) AS v FROM emb),
     unnest(range(len(v))) AS u(pos)"""))
def p10_feature_concat(spark, sf_dir):
    """P10 + F14: 64-wide vector ‖ type feature, float32."""
    e = _emb(spark, sf_dir)
    return _long(e.select("vec_id", fe.concat_type(F.col("embedding"), F.col("type")).alias("v")),
                 "vec_id", "v")


@register("f13_l2_normalize", S.with_ctes(EMB_TYPE_SQL, body="""
SELECT vec_id, CAST(u.pos AS BIGINT) AS pos,
       round(CAST(embedding[u.pos + 1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS value
FROM emb, unnest(range(len(embedding))) AS u(pos)"""))
def f13_l2_normalize(spark, sf_dir):
    """L2 normalisation of the text vectors."""
    e = _emb(spark, sf_dir)
    return _long(e.select("vec_id", fe.normalized(F.col("embedding")).alias("v")), "vec_id", "v")


@register("m1_text_vectors", S.with_ctes(S.TXN, body=f"""
SELECT doc_id, CAST(384 AS BIGINT) AS dims,
       CASE WHEN len(regexp_extract_all(strip_accents(lower(clean_description)), '{S.TOKEN_RE}')) > 0
            THEN 1.0 ELSE 0.0 END AS norm
FROM txn"""))
def m1_text_vectors(spark, sf_dir):
    """M1 (hashing encoder): 384 dimensions, unit norm unless the text has no token."""
    v = fe.HashingEncoder(384).encode(fx.txn(spark, sf_dir), "clean_description", "v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return v.select("doc_id", F.size("v").cast("long").alias("dims"),
                    F.round(norm, 6).alias("norm"))
