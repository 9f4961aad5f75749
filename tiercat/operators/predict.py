"""Hierarchical prediction on probability arrays.

Input: rows with a category probability array and a subcategory probability array
(from any model, see ``train.py``). The category is the argmax; the subcategory is the best
one among the ids allowed for that category by the category map (one row per category).
No per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tiercat.functions.arrays import argmax, masked_argmax, top_k
from tiercat.operators.prepare import label_name

NAME_BYTES = 1 << 20


def with_allowed(df: DataFrame, cmap: DataFrame, cat_id: str = "pred_category_id") -> DataFrame:
    """Allowed subcategory ids of the predicted category (left join: missing -> null,
    which means no mask)."""
    m = cmap.select(F.col("category_id").alias(cat_id), F.col("sub_ids").alias("allowed"))
    return df.join(m, cat_id, "left")


def hierarchical(df: DataFrame, cmap: DataFrame, cat_prob: str = "cat_prob",
                 sub_prob: str = "sub_prob") -> DataFrame:
    """M5: predicted category (K5), allowed set (J4), masked subcategory and both
    confidences (read back from the original arrays)."""
    d = df.withColumn("pred_category_id", argmax(F.col(cat_prob)))
    d = with_allowed(d, cmap)
    d = d.withColumn("pred_subcategory_id", masked_argmax(F.col(sub_prob), F.col("allowed")))
    return (d.withColumn("category_confidence",
                         F.element_at(F.col(cat_prob), F.col("pred_category_id") + 1))
            .withColumn("subcategory_confidence",
                        F.element_at(F.col(sub_prob), F.col("pred_subcategory_id") + 1)))


def classify(df: DataFrame, cmap: DataFrame, categories: DataFrame, subcategories: DataFrame,
             cat_prob: str = "cat_prob", sub_prob: str = "sub_prob", k: int | None = None,
             ) -> DataFrame:
    """M6/M7: decoded record per row; with ``k``, the top-k categories and the top-k allowed subcategories with
    positive confidence (K4, P14). Names are looked up in place in a list of the dictionary's names, or by
    joins with a dictionary that is too large for one (J3)."""
    out = hierarchical(df, cmap, cat_prob, sub_prob)
    names = {}
    for level, dictionary in (("category", categories), ("subcategory", subcategories)):
        names[level] = name_list(dictionary)
        at = F.col(f"pred_{level}_id")
        out = label_name(out, at, dictionary, level) if names[level] is None else \
            out.withColumn(level, F.get(names[level], at))
    if k:
        best = top_k(F.col(sub_prob), k, allowed=F.col("allowed"), positive_only=True)
        for level, dictionary, top in (("category", categories, top_k(F.col(cat_prob), k)),
                                       ("subcategory", subcategories, best)):
            to = "top_categories" if level == "category" else "top_subcategories"
            if names[level] is None:
                out = _named_top(out, top, k, dictionary, level, to)
            else:
                place = lambda i: F.get("_best", F.lit(i))
                pairs = F.array(*[F.struct(F.get(names[level], place(i)["i"]).alias(level),
                                           place(i)["score"].alias("confidence")) for i in range(k)])
                out = out.withColumn("_best", top).withColumn(
                    to, F.slice(pairs, F.lit(1), F.size("_best"))).drop("_best")
    return out


def name_list(dictionary: DataFrame, most_bytes: int = NAME_BYTES) -> Column | None:
    """All names of a label dictionary (name, id) as one array, ordered by id, that is read once a query; None if the
    dictionary's measured bytes pass ``most_bytes`` or its ids are not 0, 1, 2 and so on."""
    name, number = dictionary.columns[:2]
    size, rows, top = dictionary.agg(
        F.sum(F.octet_length(name) + 16), F.count(F.lit(1)), F.max(number)).first()
    if not rows or size > most_bytes or top != rows - 1:
        return None
    pairs = F.array_sort(F.collect_list(F.struct(F.col(number).alias("i"), F.col(name).alias("name"))))
    return dictionary.agg(F.transform(pairs, lambda x: x["name"]).alias("names")).scalar()


def _named_top(df: DataFrame, best: Column, k: int, dictionary: DataFrame, name: str,
               out: str) -> DataFrame:
    """``out``: the (index, score) pairs ``best``, at most ``k``, as (name, confidence); every
    place meets the dictionary once."""
    d = df.withColumn("_best", best)
    for i in range(k):
        d = label_name(d, F.get("_best", F.lit(i))["i"], dictionary, f"_name{i}")
    pairs = F.array(*[F.struct(F.col(f"_name{i}").alias(name),
                               F.get("_best", F.lit(i))["score"].alias("confidence")) for i in range(k)])
    return d.withColumn(out, F.slice(pairs, F.lit(1), F.size("_best"))) \
        .drop("_best", *[f"_name{i}" for i in range(k)])
