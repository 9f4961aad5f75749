"""Preparation operators: cleaning (P2-P5), rare-class filter (J1), label dictionaries
(W2, J2, J3) and the category -> subcategory map (A9, U2).

Column defaults follow the reference's table: ``clean_description``, ``type``,
``category``, ``sub_category``; ``key`` is a stable row key used wherever a total order is
needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tiercat.functions.text import strip_ws

TEXT, TYPE, CATEGORY, SUBCATEGORY = "clean_description", "type", "category", "sub_category"
CATEGORY_ID, SUBCATEGORY_ID = "category_id", "subcategory_id"


# ---------------------------------------------------------------- cleaning

def drop_missing(df: DataFrame, cols=(TEXT, CATEGORY, SUBCATEGORY)) -> DataFrame:
    """Drop rows that are null in any of ``cols``."""
    return df.na.drop(subset=list(cols))


def strip_text(df: DataFrame, text: str = TEXT) -> DataFrame:
    """Cast to string and strip Unicode whitespace on both ends."""
    return df.withColumn(text, strip_ws(F.col(text).cast("string")))


def drop_blank(df: DataFrame, text: str = TEXT) -> DataFrame:
    """Drop rows whose (stripped) text is empty."""
    return df.where(F.col(text) != "")


def clean(df: DataFrame, text: str = TEXT, category: str = CATEGORY,
          sub: str = SUBCATEGORY) -> DataFrame:
    """P2 -> P3 -> P4 as one narrow (shuffle-free) projection + filter."""
    return drop_blank(strip_text(drop_missing(df, (text, category, sub)), text), text)


# ---------------------------------------------------------------- rare filter

def class_sizes(df: DataFrame, col: str) -> DataFrame:
    """Rows per non-null class: ``(col, n)``. Partial aggregation happens map-side, so a
    class holding a third of all rows costs one counter per task, not a hot shuffle."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def filter_rare(df: DataFrame, col: str = SUBCATEGORY, min_count: int = 100) -> DataFrame:
    """Keep rows whose class has at least ``min_count`` rows (left semi join against the
    frequent-class set, one row per class)."""
    keep = class_sizes(df, col).where(F.col("n") >= min_count).select(col)
    return df.join(keep, col, "left_semi")


# ---------------------------------------------------------------- label ids

def label_dictionary(df: DataFrame, col: str, id_col: str = "id") -> DataFrame:
    """``(col, id)`` with id = position of the name in sorted order, from 0.

    The window has no partition key on purpose: it runs over the distinct label set only
    (one row per class), never over data rows."""
    names = df.where(F.col(col).isNotNull()).select(col).distinct()
    w = Window.orderBy(F.col(col))
    return names.select(col, (F.row_number().over(w) - 1).cast("int").alias(id_col))


def encode_labels(df: DataFrame, col: str, dictionary: DataFrame, id_col: str) -> DataFrame:
    """Add the id of ``col`` by an inner join with the dictionary."""
    d = dictionary.select(F.col(col), F.col(dictionary.columns[1]).alias(id_col))
    return df.join(d, col, "inner")


def decode_labels(df: DataFrame, id_col: str, dictionary: DataFrame, name_col: str) -> DataFrame:
    """Id -> name by an inner join with the dictionary."""
    d = dictionary.select(F.col(dictionary.columns[1]).alias(id_col),
                          F.col(dictionary.columns[0]).alias(name_col))
    return df.join(d, id_col, "inner")


def label_name(df: DataFrame, class_id: Column, dictionary: DataFrame, out: str) -> DataFrame:
    """J3 by a left join: ``out`` is the name of ``class_id``; every row stays, and an id that is
    null or not in the dictionary has the name null."""
    d = dictionary.select(F.col(dictionary.columns[1]).alias("_id"), F.col(dictionary.columns[0]).alias("_name"))
    return df.withColumn("_class", class_id).join(d, F.col("_class") == F.col("_id"), "left") \
        .withColumn(out, F.col("_name")).drop("_class", "_id", "_name")


@dataclass
class Encoded:
    """A cleaned, filtered table with both label ids, plus its two dictionaries."""
    df: DataFrame
    categories: DataFrame       # (category, category_id)
    subcategories: DataFrame    # (sub_category, subcategory_id)


def encode_both(df: DataFrame, category: str = CATEGORY, sub: str = SUBCATEGORY) -> Encoded:
    """J2 for both levels. Dictionaries are built on all rows (before the split), as the
    reference does; they carry labels, not features."""
    cats = label_dictionary(df, category, CATEGORY_ID)
    subs = label_dictionary(df, sub, SUBCATEGORY_ID)
    out = encode_labels(encode_labels(df, category, cats, CATEGORY_ID), sub, subs, SUBCATEGORY_ID)
    return Encoded(out, cats, subs)


# ---------------------------------------------------------------- category map

def category_map(df: DataFrame, cat_id: str = CATEGORY_ID, sub_id: str = SUBCATEGORY_ID,
                 out: str = "sub_ids") -> DataFrame:
    """``(category_id, sub_ids)`` with the sorted distinct subcategory ids observed
    under each category. Distinct pairs are reduced first (map-side), so the list per
    category is bounded by the number of subcategory classes whatever the row skew."""
    pairs = df.select(cat_id, sub_id).distinct()
    return pairs.groupBy(cat_id).agg(F.array_sort(F.collect_list(sub_id)).alias(out))


def subcategories_per_category(df: DataFrame, category: str = CATEGORY,
                               sub: str = SUBCATEGORY) -> DataFrame:
    """Distinct subcategories per (named) category."""
    return (df.where(F.col(category).isNotNull())
            .groupBy(category).agg(F.countDistinct(sub).alias("n_subcategories")))


# ---------------------------------------------------------------- row accounting (P5)

def row_accounting(raw: DataFrame, text: str = TEXT, category: str = CATEGORY,
                   sub: str = SUBCATEGORY, min_count: int = 100) -> DataFrame:
    """P5: initial rows, rows removed for missing values, rows after cleaning, rows after
    the rare filter, in one pass: flags per row, one (partially aggregated) group-by on the
    subcategory, then a one-row total."""
    complete = F.col(text).isNotNull() & F.col(category).isNotNull() & F.col(sub).isNotNull()
    kept = complete & (strip_ws(F.col(text).cast("string")) != "")
    per_class = raw.groupBy(sub).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(complete).alias("n_complete"),
        F.count_if(kept).alias("n_clean"))
    return per_class.agg(
        F.sum("n_all").cast("long").alias("initial_rows"),
        (F.sum("n_all") - F.sum("n_complete")).cast("long").alias("removed_missing"),
        F.sum("n_clean").cast("long").alias("rows_after_cleaning"),
        F.coalesce(F.sum(F.when(F.col("n_clean") >= min_count, F.col("n_clean"))),
                   F.lit(0)).cast("long").alias("rows_after_rare_filter"))
