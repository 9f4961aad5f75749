"""Exact stratified train/validation split (W3) and its checks.

Semantics (trap T5): validation total is ceil(test_size * N); the training quota of class c
is floor(n_c * n_train / N), plus one for the classes with the largest remainders (ties by
class name) until the quotas sum to n_train. Inside a class, rows are ordered by
md5(key || '|' || seed), then key, and the first quota rows go to train.

Scale: a class may hold a third of all rows, so no task ever sorts a whole class, and no text
is moved to decide a split. A narrow table (key, class, hash) is written once; a (class, hash
bucket) histogram of it locates, per class, the one bucket where the quota ends; only that
bucket's narrow rows are ranked, which gives the class's boundary (hash, key). The rows
themselves are then read once and compared with their class's boundary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tiercat.operators import prepare as prep
from tiercat.operators.prepare import class_sizes
from tiercat.session import materialize

HASH_PREFIX_CHARS = 4  # 16 bits -> up to 65,536 buckets per class


def row_hash(key: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), F.lit(str(seed))))


def split_quotas(sizes: DataFrame, stratify: str, test_size: float = 0.2) -> DataFrame:
    """Per-class training quota ``(stratify, n, n_train)`` by the largest-remainder rule,
    in exact integer (decimal) arithmetic. Runs over one row per class."""
    d = "decimal(38,0)"
    w_all = Window.partitionBy(F.lit(1))  # one row per class: a tiny single-partition window
    q = (sizes
         .withColumn("total", F.sum("n").over(w_all).cast("long"))
         .withColumn("t_train", F.col("total") - F.ceil(F.col("total") * F.lit(float(test_size))
                                                       .cast("double")).cast("long"))
         .withColumn("prod", F.col("n").cast(d) * F.col("t_train").cast(d))
         .withColumn("base", F.floor(F.col("prod") / F.col("total").cast(d)).cast("long"))
         .withColumn("rem", (F.col("prod") - F.col("base").cast(d) * F.col("total").cast(d))))
    w_rank = Window.orderBy(F.col("rem").desc(), F.col(stratify))
    q = (q.withColumn("need", F.col("t_train") - F.sum("base").over(w_all))
         .withColumn("r", F.row_number().over(w_rank))
         .withColumn("n_train", F.col("base") + F.when(F.col("r") <= F.col("need"), 1)
                     .otherwise(0)))
    return q.select(stratify, "n", F.col("n_train").cast("long"))


def boundaries(narrow: DataFrame, quotas: DataFrame, stratify: str, key: str) -> DataFrame:
    """``(stratify, _hstar, _kstar)``: the last training row of each class in (hash, key) order.
    ``narrow`` is a written table ``(key, stratify, _h)``; classes whose quota is 0 have no row
    here."""
    rows = narrow.withColumn("_b", F.substring("_h", 1, HASH_PREFIX_CHARS))
    hist = rows.groupBy(stratify, "_b").agg(F.count(F.lit(1)).alias("cnt"))
    w = (Window.partitionBy(stratify).orderBy("_b")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hist = hist.withColumn("cum", F.sum("cnt").over(w))
    before = F.col("cum") - F.col("cnt")
    edge = (hist.join(quotas, stratify)
            .where((F.col("n_train") > 0) & (F.col("cum") >= F.col("n_train")) &
                   (before < F.col("n_train")))
            .select(stratify, "_b", (F.col("n_train") - before).alias("_take")))
    # about n_class / 65,536 rows per class
    order = Window.partitionBy(stratify).orderBy("_h", key)
    return (rows.join(edge, [stratify, "_b"]).withColumn("_r", F.row_number().over(order))
            .where(F.col("_r") == F.col("_take"))
            .select(stratify, F.col("_h").alias("_hstar"), F.col(key).alias("_kstar")))


def _side(key: str) -> F.Column:
    """'train' up to and including the class's boundary row, else 'val'."""
    inside = (F.col("_h") < F.col("_hstar")) | \
        ((F.col("_h") == F.col("_hstar")) & (F.col(key) <= F.col("_kstar")))
    return F.when(F.coalesce(inside, F.lit(False)), "train").otherwise("val")


def stratified_split(df: DataFrame, stratify: str, key: str, test_size: float = 0.2,
                     seed: int = 42, split_col: str = "split") -> DataFrame:
    """``df`` plus ``split_col`` in {'train', 'val'}; exact per-class quotas. ``df`` is read
    twice, first for its key and class only."""
    narrow = materialize(df.sparkSession, df.select(key, stratify, row_hash(key, seed).alias("_h")),
                         "split-keys")
    quotas = split_quotas(class_sizes(narrow, stratify), stratify, test_size)
    bounds = materialize(df.sparkSession, boundaries(narrow, quotas, stratify, key), "split-bounds")
    rows = df.withColumn("_h", row_hash(key, seed)).join(bounds, stratify, "left")
    return rows.withColumn(split_col, _side(key)).drop("_h", "_hstar", "_kstar")


def prepare_and_split(df: DataFrame, min_count: int, key: str = "doc_id",
                      test_size: float = 0.2, seed: int = 42, text: str = prep.TEXT,
                      category: str = prep.CATEGORY, sub: str = prep.SUBCATEGORY,
                      split_col: str = "split") -> prep.Encoded:
    """The whole preparation stage with two readings of the rows.

    The first writes a narrow table (key, labels, hash) of the cleaned rows. From it come the
    rare filter (J1), both label dictionaries (W2), the quotas (W3) and each class's boundary
    row, all kept in one written dictionary by (category, subcategory). The second reading
    joins the cleaned rows with that dictionary (rare pairs are absent, so the inner join is
    the filter; small as it is, the planner broadcasts it) and compares hashes: one scan of the
    text and no shuffle of it. Same result as clean -> filter_rare -> encode_both ->
    stratified_split."""
    spark = df.sparkSession
    c = prep.clean(df, text, category, sub)
    h = row_hash(key, seed)
    narrow = materialize(spark, c.select(key, category, sub, h.alias("_h")), "prepare-keys")
    pair_n = materialize(spark, narrow.groupBy(category, sub).agg(F.count(F.lit(1)).alias("n")),
                         "label-pairs")
    sub_n = pair_n.groupBy(sub).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    kept = pair_n.join(sub_n.select(sub), sub, "left_semi")
    cats = materialize(spark, prep.label_dictionary(kept, category, prep.CATEGORY_ID), "categories")
    subs = materialize(spark, prep.label_dictionary(kept, sub, prep.SUBCATEGORY_ID), "subcategories")
    sid = prep.SUBCATEGORY_ID
    sizes = sub_n.join(subs, sub).select(sid, "n")
    bounds = boundaries(narrow.join(subs, sub).select(key, sid, "_h"),
                        split_quotas(sizes, sid, test_size), sid, key)
    pairs = materialize(spark, kept.select(category, sub).join(cats, category).join(subs, sub)
                        .join(bounds, sid, "left"), "split-pairs")
    rows = c.withColumn("_h", h).join(pairs, [category, sub], "inner")
    out = rows.withColumn(split_col, _side(key)).drop("_h", "_hstar", "_kstar")
    return prep.Encoded(out, cats, subs)


def split_shares(df: DataFrame, label: str, split_col: str = "split") -> DataFrame:
    """Share of each class inside each split, ``(split, label, n, share)``."""
    counts = df.groupBy(split_col, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(split_col)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w))


def top_shares(df: DataFrame, label: str, k: int = 5, split_col: str = "split") -> DataFrame:
    """A2: normalised value counts per split, top ``k`` (share desc, label asc)."""
    s = split_shares(df, label, split_col)
    w = Window.partitionBy(split_col).orderBy(F.col("n").desc(), F.col(label))
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
