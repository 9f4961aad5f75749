"""Registered queries: keyword mining on deterministic weights (A13, W1, J7/J8, P12, A21,
M10, F11/F15/S8 as flat rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tiercat.operators import keywords as kw
from tiercat.plans import fixtures as fx
from tiercat.plans import sql as S
from tiercat.plans.registry import register

LEVELS = (("category", "category_id"), ("sub_category", "subcategory_id"))
BASE = (S.prepared_txn(), S.tfidf(), S.keyword_stats("category_id", "c"),
        S.keyword_stats("subcategory_id", "s"))


def _r6(c):
    return F.round(c.cast("double"), 6)


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def _statistics(spark, sf_dir):
    """Inputs of both levels, from one pass over the presence rows that is written once."""
    f, presence, docs = fx.keyword_inputs(spark, sf_dir)
    supports, sizes = fx.supports(spark, sf_dir, presence, docs)
    for lvl, cls in LEVELS:
        yield lvl, cls, f, kw.level_statistics(supports, sizes[cls], cls), sizes[cls]


def _levels(spark, sf_dir):
    for lvl, cls, f, stats, sizes in _statistics(spark, sf_dir):
        yield lvl, cls, fx.stand_in_weights(f, stats, sizes, 40), stats, sizes


def _mined(spark, sf_dir, filtering=True):
    for lvl, cls, w, stats, sizes in _levels(spark, sf_dir):
        yield lvl, kw.keywords(w, None, None, cls, 40, filtering, stats=stats, sizes=sizes)


@register("a13_term_statistics", S.with_ctes(*BASE, body="""
SELECT 'category' AS level, CAST(class_id AS BIGINT) AS class_id, term, support_class,
       support_total, n_class, round(dominance, 6) AS dominance, round(p_in_class, 6) AS p_in_class
FROM c_stats
UNION ALL
SELECT 'sub_category', class_id, term, support_class, support_total, n_class,
       round(dominance, 6), round(p_in_class, 6)
FROM s_stats"""))
def a13_term_statistics(spark, sf_dir):
    return _union([stats.select(
        F.lit(lvl).alias("level"), F.col("class_id").cast("long"), "term",
        F.col("support_class").cast("long"), F.col("support_total").cast("long"),
        F.col("n_class").cast("long"), _r6(F.col("dominance")).alias("dominance"),
        _r6(F.col("p_in_class")).alias("p_in_class"))
        for lvl, cls, f, stats, _ in _statistics(spark, sf_dir)])


@register("w1_top_terms", S.with_ctes(*BASE, body="""
SELECT 'category' AS level, CAST(class_id AS BIGINT) AS class_id, direction,
       CAST(rank AS BIGINT) AS rank, term, weight FROM c_cand
UNION ALL
SELECT 'sub_category', class_id, direction, rank, term, weight FROM s_cand"""))
def w1_top_terms(spark, sf_dir):
    """W1 (and M10 with apply_filtering=False): top 40 terms each way per class."""
    return _union([kw.top_terms(w, 40).select(
        F.lit(lvl).alias("level"), F.col("class_id").cast("long"), "direction",
        F.col("rank").cast("long"), "term", "weight") for lvl, cls, w, _, _ in _levels(spark, sf_dir)])


_J8 = """
SELECT '{lvl}' AS level, CAST(c.class_id AS BIGINT) AS class_id, c.direction,
       CAST(c.rank AS BIGINT) AS rank, c.term, coalesce(s.support_class, 0) AS support_class,
       t.support_total, round(coalesce(s.support_class, 0) / t.support_total, 6) AS dominance
FROM {p}_cand c JOIN {p}_st t ON t.term = c.term
LEFT JOIN {p}_sc s ON s.class_id = c.class_id AND s.term = c.term"""


@register("j8_candidate_statistics", S.with_ctes(
    *BASE, body=_J8.format(lvl="category", p="c") + "\nUNION ALL" + _J8.format(lvl="sub_category", p="s")))
def j8_candidate_statistics(spark, sf_dir):
    """J7 + J8: ranked candidates with their statistics, zero support kept."""
    return _union([kw.candidate_statistics(kw.top_terms(w, 40), stats, sizes).select(
        F.lit(lvl).alias("level"), F.col("class_id").cast("long"), "direction",
        F.col("rank").cast("long"), "term", F.col("support_class").cast("long"),
        F.col("support_total").cast("long"), _r6(F.col("dominance")).alias("dominance"))
        for lvl, cls, w, stats, sizes in _levels(spark, sf_dir)])


_P12 = """
SELECT '{lvl}' AS level, CAST(class_id AS BIGINT) AS class_id, term, support_class,
       round(dominance, 6) AS dominance
FROM {p}_stats WHERE (support_class >= 3 AND dominance >= 0.05) OR dominance >= 0.5"""


@register("p12_keyword_filter", S.with_ctes(
    *BASE, body=_P12.format(lvl="category", p="c") + "\nUNION ALL" + _P12.format(lvl="sub_category", p="s")))
def p12_keyword_filter(spark, sf_dir):
    """P12 over every observed (class, term) pair of both levels."""
    return _union([stats.where(kw.keep_predicate()).select(
        F.lit(lvl).alias("level"), F.col("class_id").cast("long"), "term",
        F.col("support_class").cast("long"), _r6(F.col("dominance")).alias("dominance"))
        for lvl, cls, f, stats, _ in _statistics(spark, sf_dir)])


@register("m10_keywords", S.with_ctes(*BASE, body="""
SELECT 'category' AS level, CAST(class_id AS BIGINT) AS class_id, direction,
       CAST(rank AS BIGINT) AS rank, term, weight, support_class, round(dominance, 6) AS dominance
FROM c_kw
UNION ALL
SELECT 'sub_category', class_id, direction, rank, term, weight, support_class, round(dominance, 6)
FROM s_kw"""))
def m10_keywords(spark, sf_dir):
    """Ranked (W1), looked up (J7/J8) and filtered (P12) keywords per class."""
    return _union([k.select(
        F.lit(lvl).alias("level"), F.col("class_id").cast("long"), "direction",
        F.col("rank").cast("long"), "term", "weight", F.col("support_class").cast("long"),
        _r6(F.col("dominance")).alias("dominance"))
        for lvl, k in _mined(spark, sf_dir)])


_A21 = """
SELECT '{lvl}' AS level, (SELECT count(*) FROM {d}) AS n_classes,
       count(*) FILTER (WHERE direction = 'include') AS n_include,
       count(*) FILTER (WHERE direction = 'exclude') AS n_exclude FROM {p}_kw"""


@register("a21_keyword_totals", S.with_ctes(
    *BASE, body=_A21.format(lvl="category", d="cat_dict", p="c") + "\nUNION ALL"
    + _A21.format(lvl="sub_category", d="sub_dict", p="s")))
def a21_keyword_totals(spark, sf_dir):
    """All classes of a level count, with keywords or without."""
    p = fx.prepared_txn(spark, sf_dir)
    names = _union([d.select(F.lit(lvl).alias("level"), F.col(cls).alias("class_id")) for (lvl, cls), d in
                    zip(LEVELS, (p.categories, p.subcategories))])
    rows = _union([k.withColumn("level", F.lit(lvl)) for lvl, k in _mined(spark, sf_dir)])
    return kw.keyword_totals(rows, names).select(
        "level", *[F.col(c).cast("long").alias(c) for c in ("n_classes", "n_include", "n_exclude")])


_S8 = """
SELECT '{lvl}' AS level, d.{n} AS class_name, k.direction,
       row_number() OVER (PARTITION BY k.class_id, k.direction ORDER BY k.rank) AS position,
       k.term, k.weight, k.support_class, round(k.dominance, 3) AS dominance
FROM {p}_kw k JOIN {d} d ON d.{c} = k.class_id"""


def _documents(spark, sf_dir, filtering=True):
    p = fx.prepared_txn(spark, sf_dir)
    names = {"category": p.categories, "sub_category": p.subcategories}
    return _union([kw.keyword_documents(k, names[lvl], lvl) for lvl, k in _mined(spark, sf_dir, filtering)])


@register("s8_keyword_json", S.with_ctes(
    *BASE, body=_S8.format(lvl="category", n="category", c="category_id", d="cat_dict", p="c") + "\nUNION ALL"
    + _S8.format(lvl="sub_category", n="sub_category", c="subcategory_id", d="sub_dict", p="s")))
def s8_keyword_json(spark, sf_dir):
    """S8 + F15 + F11: the keyword document written as JSON lines, read back and laid out flat."""
    f = fx.text_features(spark, sf_dir)
    path = fx.written_json(spark, kw.keyword_file(_documents(spark, sf_dir), {
        "vocabulary_size": f.model.size, "top_n": 40, "min_support_class": kw.MIN_SUPPORT_CLASS,
        "min_dominance": kw.MIN_DOMINANCE}), "keywords")
    item = "array<struct<term:string,weight:double,support_class:bigint,dominance:double>>"
    back = spark.read.schema("section string, level string, class_name string, keywords string").json(path) \
        .where("section = 'classes'")
    doc = back.select("level", "class_name", F.from_json("keywords", f"struct<include:{item},exclude:{item}>").alias("k"))
    return _union([doc.select("level", "class_name", F.lit(d).alias("direction"),
                              F.posexplode(f"k.{d}").alias("p", "z")) for d in ("include", "exclude")]).select(
        "level", "class_name", "direction", (F.col("p") + 1).cast("long").alias("position"), "z.term", "z.weight",
        "z.support_class", "z.dominance")


_F15 = """
SELECT '{lvl}' AS level, d.{n} AS class_name,
       (SELECT count(*) FROM {p}_kw k WHERE k.class_id = d.{c} AND k.direction = 'include') AS n_include,
       (SELECT count(*) FROM {p}_kw k WHERE k.class_id = d.{c} AND k.direction = 'exclude') AS n_exclude,
       (SELECT count(*) FROM {p}_cand k WHERE k.class_id = d.{c}) AS n_unfiltered
FROM {d} d"""


@register("f15_empty_class", S.with_ctes(
    *BASE, body=_F15.format(lvl="category", n="category", c="category_id", d="cat_dict", p="c") + "\nUNION ALL"
    + _F15.format(lvl="sub_category", n="sub_category", c="subcategory_id", d="sub_dict", p="s")))
def f15_empty_class(spark, sf_dir):
    """both lists of every class, empty ones included, and the unfiltered form's size."""
    size = lambda d, path: F.json_array_length(F.get_json_object(d, path)).cast("long")
    a = _documents(spark, sf_dir).select("level", "class_name", size("keywords", "$.include").alias("n_include"),
                                         size("keywords", "$.exclude").alias("n_exclude"))
    b = _documents(spark, sf_dir, False).select(
        "level", "class_name",
        (size("keywords", "$.include") + size("keywords", "$.exclude")).alias("n_unfiltered"))
    return a.join(b, ["level", "class_name"])


@register("a22_metadata_counts", S.with_ctes(S.prepared_txn(), S.tfidf(), body="""
SELECT (SELECT count(*) FROM vocab) AS vocabulary_size,
       (SELECT count(*) FROM cat_dict) AS n_categories,
       (SELECT count(*) FROM sub_dict) AS n_subcategories,
       count(*) FILTER (WHERE split = 'train') AS n_train,
       count(*) FILTER (WHERE split = 'val') AS n_val,
       round(100.0 * count(*) FILTER (WHERE split = 'train') / count(*), 6) AS train_pct,
       round(100.0 * count(*) FILTER (WHERE split = 'val') / count(*), 6) AS val_pct
FROM prepared"""))
def a22_metadata_counts(spark, sf_dir):
    """A22 + F12: vocabulary size, class counts, split sizes and shares."""
    f = fx.text_features(spark, sf_dir)
    p = f.prepared
    n_cat, n_sub = fx.class_count(p.categories), fx.class_count(p.subcategories)
    tr, va = F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "val")
    return p.rows.agg(
        F.lit(f.model.size).cast("long").alias("vocabulary_size"),
        F.lit(n_cat).cast("long").alias("n_categories"),
        F.lit(n_sub).cast("long").alias("n_subcategories"),
        tr.cast("long").alias("n_train"), va.cast("long").alias("n_val"),
        _r6(tr * 100.0 / F.count(F.lit(1))).alias("train_pct"),
        _r6(va * 100.0 / F.count(F.lit(1))).alias("val_pct"))
