"""Registered queries: sources and preparation (S1-S4, P2-P5, J1, J2, W2, W3, W4, A2, A6,
A8, A9/U2/S7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tiercat.operators import prepare as prep
from tiercat.operators import split as sp
from tiercat.operators.profile import threshold_counts, value_counts
from tiercat.plans import fixtures as fx
from tiercat.plans import sql as S
from tiercat.plans.registry import register
from tiercat.session import scratch_path
from tiercat.sources.io import cap_rows, read_csv, read_split, read_table, write_splits


PREP = S.prepared_txn()


def _r6(c):
    return F.round(c.cast("double"), 6)


# ---------------------------------------------------------------- sources

@register("s2_row_cap", S.with_ctes(S.TXN, body="""
SELECT doc_id, category, sub_category FROM txn ORDER BY doc_id LIMIT 300"""))
def s2_row_cap(spark, sf_dir):
    """S2 with a cap below the table's size, deterministic by key."""
    return cap_rows(fx.txn(spark, sf_dir), 300, order_by="doc_id") \
        .select("doc_id", "category", "sub_category")


@register("s2_file_head", "SELECT doc_id, lang, source FROM documents LIMIT 300")
def s2_file_head(spark, sf_dir):
    """S2 without a key: the first rows of the file, in its order."""
    return cap_rows(read_table(spark, sf_dir, "documents"), 300).select("doc_id", "lang", "source")


_CSV = """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang AS category,
       CASE WHEN doc_id % 5 > 1 THEN source END AS sub_category FROM documents"""


@register("s1_csv_scan", _CSV)
def s1_csv_scan(spark, sf_dir):
    """A CSV of the documents (quotes, commas and newlines in texts, null tokens for some sources), read back as
    strings."""
    d = read_table(spark, sf_dir, "documents")
    token = F.when(F.col("doc_id") % 5 == 0, "NA").when(F.col("doc_id") % 5 == 1, "null").otherwise(F.col("source"))
    path = scratch_path(spark, f"{spark.sparkContext.applicationId}/csv-{uuid.uuid4().hex}")
    (d.select("doc_id", "text", F.col("lang").alias("category"), token.alias("sub_category"))
     .write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_csv(spark, path, multi_line=True)


@register("s3_split_sink", S.with_ctes(PREP, body="""
SELECT split, doc_id, CAST(category_id AS BIGINT) AS category_id,
       CAST(subcategory_id AS BIGINT) AS subcategory_id, clean_description FROM prepared"""))
def s3_split_sink(spark, sf_dir):
    """S3: the prepared rows written by split, and each split read back on its own."""
    path = scratch_path(spark, f"{spark.sparkContext.applicationId}/splits-{uuid.uuid4().hex}")
    write_splits(fx.prepared_txn(spark, sf_dir).rows, path)
    both = read_split(spark, path, "train").unionByName(read_split(spark, path, "val"))
    return both.select("split", "doc_id", F.col("category_id").cast("long"), F.col("subcategory_id").cast("long"),
                       "clean_description")


@register("s4_txn_scan", S.with_ctes(S.TXN, body="""
SELECT doc_id, clean_description, type, category, sub_category FROM txn"""))
def s4_txn_scan(spark, sf_dir):
    """Parquet scans (pruned to the used columns) joined into the main table."""
    return fx.txn(spark, sf_dir)


# ---------------------------------------------------------------- cleaning

@register("p2_drop_missing", S.with_ctes(S.TXN_NULLS, body="""
SELECT doc_id, clean_description, category, sub_category FROM txn_nulls
WHERE clean_description IS NOT NULL AND category IS NOT NULL AND sub_category IS NOT NULL"""))
def p2_drop_missing(spark, sf_dir):
    return prep.drop_missing(fx.txn_nulls(spark, sf_dir)) \
        .select("doc_id", "clean_description", "category", "sub_category")


@register("p3_strip_text", S.with_ctes(S.TXN_NULLS, body=f"""
SELECT doc_id, {S.STRIP} AS clean_description,
       CAST(length({S.STRIP}) AS BIGINT) AS n_chars
FROM txn_nulls
WHERE clean_description IS NOT NULL AND category IS NOT NULL AND sub_category IS NOT NULL"""))
def p3_strip_text(spark, sf_dir):
    df = prep.strip_text(prep.drop_missing(fx.txn_nulls(spark, sf_dir)))
    return df.select("doc_id", "clean_description",
                     F.length("clean_description").cast("long").alias("n_chars"))


@register("p4_drop_blank", S.with_ctes(S.TXN_NULLS, S.cleaned("txn_nulls"), body="""
SELECT doc_id, category, sub_category FROM cleaned"""))
def p4_drop_blank(spark, sf_dir):
    return prep.clean(fx.txn_nulls(spark, sf_dir)).select("doc_id", "category", "sub_category")


@register("p5_row_accounting", S.with_ctes(S.TXN_NULLS, S.cleaned("txn_nulls"), body=f"""
SELECT (SELECT count(*) FROM txn_nulls) AS initial_rows,
       (SELECT count(*) FROM txn_nulls WHERE clean_description IS NULL OR category IS NULL
                                          OR sub_category IS NULL) AS removed_missing,
       (SELECT count(*) FROM cleaned) AS rows_after_cleaning,
       (SELECT count(*) FROM cleaned WHERE sub_category IN (
            SELECT sub_category FROM cleaned GROUP BY 1
            HAVING count(*) >= {S.ORACLE_MIN_COUNT})) AS rows_after_rare_filter"""))
def p5_row_accounting(spark, sf_dir):
    return prep.row_accounting(fx.txn_nulls(spark, sf_dir, with_type=False), min_count=fx.RARE_THRESHOLD)


# ---------------------------------------------------------------- rare filter, ids

@register("j1_rare_filter", S.with_ctes(S.TXN, S.cleaned("txn"), body=f"""
SELECT doc_id, sub_category FROM cleaned WHERE sub_category IN (
  SELECT sub_category FROM cleaned GROUP BY 1 HAVING count(*) >= {S.ORACLE_MIN_COUNT})"""))
def j1_rare_filter(spark, sf_dir):
    df = prep.filter_rare(prep.clean(fx.txn(spark, sf_dir)), "sub_category",
                          fx.RARE_THRESHOLD)
    return df.select("doc_id", "sub_category")


@register("a6_rare_classes", S.with_ctes(S.TXN, S.cleaned("txn"), body=f"""
SELECT count(*) AS n_classes_before,
       count(*) FILTER (WHERE n < {S.ORACLE_MIN_COUNT}) AS n_rare,
       count(*) FILTER (WHERE n >= {S.ORACLE_MIN_COUNT}) AS n_classes_after
FROM (SELECT sub_category, count(*) AS n FROM cleaned GROUP BY 1)"""))
def a6_rare_classes(spark, sf_dir):
    t = fx.RARE_THRESHOLD
    counts = value_counts(prep.clean(fx.txn(spark, sf_dir, with_type=False)), "sub_category")
    return counts.agg(F.count(F.lit(1)).cast("long").alias("n_classes_before"),
                      F.count_if(F.col("n") < t).cast("long").alias("n_rare"),
                      F.count_if(F.col("n") >= t).cast("long").alias("n_classes_after"))


@register("p8_threshold_counts", S.with_ctes(S.TXN, body="""
SELECT count(*) AS n_classes,
       count(*) FILTER (WHERE n < 100) AS below_100,
       count(*) FILTER (WHERE n < 50) AS below_50,
       count(*) FILTER (WHERE n < 10) AS below_10
FROM (SELECT sub_category, count(*) AS n FROM txn WHERE sub_category IS NOT NULL GROUP BY 1)"""))
def p8_threshold_counts(spark, sf_dir):
    return threshold_counts(value_counts(fx.txn(spark, sf_dir, with_type=False), "sub_category"), (100, 50, 10))


@register("w2_label_ids", S.with_ctes(S.prepared_txn(), body="""
SELECT 'category' AS level, category AS name, CAST(category_id AS BIGINT) AS id FROM cat_dict
UNION ALL
SELECT 'sub_category', sub_category, CAST(subcategory_id AS BIGINT) FROM sub_dict"""))
def w2_label_ids(spark, sf_dir):
    p = fx.prepared_txn(spark, sf_dir)
    c = p.categories.select(F.lit("category").alias("level"), F.col("category").alias("name"),
                            F.col("category_id").cast("long").alias("id"))
    s = p.subcategories.select(F.lit("sub_category").alias("level"),
                               F.col("sub_category").alias("name"),
                               F.col("subcategory_id").cast("long").alias("id"))
    return c.unionByName(s)


@register("j2_label_encoding", S.with_ctes(S.prepared_txn(), body="""
SELECT doc_id, CAST(category_id AS BIGINT) AS category_id,
       CAST(subcategory_id AS BIGINT) AS subcategory_id FROM enc"""))
def j2_label_encoding(spark, sf_dir):
    kept = prep.filter_rare(prep.clean(fx.txn(spark, sf_dir)), "sub_category",
                            fx.RARE_THRESHOLD)
    enc = prep.encode_both(kept)
    return enc.df.select("doc_id", F.col("category_id").cast("long"),
                         F.col("subcategory_id").cast("long"))


@register("a9_category_map", S.with_ctes(S.prepared_txn(), body="""
SELECT CAST(category_id AS BIGINT) AS category_id,
       array_to_string(list_sort(list(DISTINCT subcategory_id)), ',') AS sub_ids,
       CAST(count(DISTINCT subcategory_id) AS BIGINT) AS n_sub
FROM enc GROUP BY category_id"""))
def a9_category_map(spark, sf_dir):
    """A9/U2 (and the S7 payload): sorted distinct subcategory ids per category."""
    p = fx.prepared_txn(spark, sf_dir)
    m = prep.category_map(p.rows)
    return m.select(F.col("category_id").cast("long"),
                    F.array_join("sub_ids", ",").alias("sub_ids"),
                    F.size("sub_ids").cast("long").alias("n_sub"))


@register("a9_category_map_m2m", S.with_ctes(S.TXN_M2M, S.prepared("txn_m2m"), body="""
SELECT c.category, array_to_string(list_sort(list(DISTINCT e.sub_category)), ',') AS sub_names,
       array_to_string(list_sort(list(DISTINCT e.subcategory_id)), ',') AS sub_ids
FROM enc e JOIN cat_dict c USING (category) GROUP BY c.category"""))
def a9_category_map_m2m(spark, sf_dir):
    """A9 on a table where one subcategory sits under several categories."""
    p = fx.prepare(fx.txn_m2m(spark, sf_dir), fx.RARE_THRESHOLD)
    m = prep.category_map(p.rows)
    names = (p.rows.select("category", "sub_category").distinct()
             .groupBy("category").agg(F.array_sort(F.collect_list("sub_category")).alias("s")))
    return (prep.decode_labels(m, "category_id", p.categories, "category")
            .join(names, "category")
            .select("category", F.array_join("s", ",").alias("sub_names"),
                    F.array_join("sub_ids", ",").alias("sub_ids")))


@register("a8_subcategories_per_category", S.with_ctes(S.TXN, S.TXN_M2M, body="""
SELECT 'txn' AS src, category, count(DISTINCT sub_category) AS n_subcategories
FROM txn WHERE category IS NOT NULL GROUP BY category
UNION ALL
SELECT 'txn_m2m', category, count(DISTINCT sub_category) FROM txn_m2m
WHERE category IS NOT NULL GROUP BY category"""))
def a8_subcategories_per_category(spark, sf_dir):
    a = prep.subcategories_per_category(fx.txn(spark, sf_dir)).withColumn("src", F.lit("txn"))
    b = prep.subcategories_per_category(fx.txn_m2m(spark, sf_dir)) \
        .withColumn("src", F.lit("txn_m2m"))
    return a.unionByName(b).select("src", "category",
                                   F.col("n_subcategories").cast("long"))


# ---------------------------------------------------------------- split

@register("w3_stratified_split", S.with_ctes(S.prepared_txn(), body="""
SELECT doc_id, CAST(subcategory_id AS BIGINT) AS subcategory_id, split FROM prepared"""))
def w3_stratified_split(spark, sf_dir):
    p = fx.prepared_txn(spark, sf_dir)
    return p.rows.select("doc_id", F.col("subcategory_id").cast("long"), "split")


@register("w4_split_shares", S.with_ctes(S.prepared_txn(), body="""
SELECT split, category, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share
FROM prepared GROUP BY split, category"""))
def w4_split_shares(spark, sf_dir):
    s = sp.split_shares(fx.prepared_txn(spark, sf_dir).rows, "category")
    return s.select("split", "category", F.col("n").cast("long"), _r6(F.col("share")).alias("share"))


@register("a2_split_top_shares", S.with_ctes(S.prepared_txn(), body="""
SELECT split, sub_category, n, round(share, 6) AS share, rank FROM (
  SELECT split, sub_category, count(*) AS n,
         count(*) / sum(count(*)) OVER (PARTITION BY split) AS share,
         row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, sub_category) AS rank
  FROM prepared GROUP BY split, sub_category) WHERE rank <= 5"""))
def a2_split_top_shares(spark, sf_dir):
    s = sp.top_shares(fx.prepared_txn(spark, sf_dir).rows, "sub_category", 5)
    return s.select("split", "sub_category", F.col("n").cast("long"),
                    _r6(F.col("share")).alias("share"), F.col("rank").cast("long"))


@register("w3_split_quotas", S.with_ctes(S.prepared_txn(), body="""
SELECT CAST(subcategory_id AS BIGINT) AS subcategory_id, count(*) AS n,
       count(*) FILTER (WHERE split = 'train') AS n_train,
       count(*) FILTER (WHERE split = 'val') AS n_val
FROM prepared GROUP BY subcategory_id"""))
def w3_split_quotas(spark, sf_dir):
    """W3 check in aggregate form: rows per class and split."""
    rows = fx.prepared_txn(spark, sf_dir).rows
    return rows.groupBy(F.col("subcategory_id").cast("long").alias("subcategory_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("split") == "train").cast("long").alias("n_train"),
        F.count_if(F.col("split") == "val").cast("long").alias("n_val"))
