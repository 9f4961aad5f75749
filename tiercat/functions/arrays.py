"""Array expressions over per-row probability vectors.

Probabilities are ``ARRAY<DOUBLE>`` columns indexed by class id. Every function is a
higher-order SQL expression, so there is no per-row Python loop.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def argmax(p: Column) -> Column:
    """K5: index of the largest value, lowest index on ties (0-based)."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def array_max(p: Column) -> Column:
    """largest value (the confidence of an argmax prediction)."""
    return F.array_max(p)


def _scored(p: Column) -> Column:
    # struct(k = -score, i = index): ascending order = score desc, index asc.
    return F.transform(p, lambda x, i: F.struct((-x).alias("k"), i.alias("i")))


def _candidates(p: Column, allowed: Column | None) -> Column:
    """Sort structs of the entries that may win: those of ``allowed``, read one by one, or all where
    the allowed set is null or empty (trap T7). Ids outside ``p`` are left out."""
    if allowed is None:
        return _scored(p)
    some = F.transform(F.array_distinct(allowed),
                       lambda i: F.struct((-F.get(p, i)).alias("k"), i.cast("int").alias("i")))
    return F.when(F.size(allowed) > 0, F.filter(some, lambda z: z["k"].isNotNull())).otherwise(_scored(p))


def masked_argmax(p: Column, allowed: Column | None) -> Column:
    """M5: best index among ``allowed`` (score desc, index asc); all indices when the
    allowed set is null or empty. The winner is always inside the allowed set."""
    best = F.array_min(_candidates(p, allowed))
    return best["i"].cast("int")


def mask_to_zero(p: Column, allowed: Column) -> Column:
    """keep allowed entries, set the others to 0 (no mask when allowed is null/empty)."""
    masked = F.transform(p, lambda x, i: F.when(F.array_contains(allowed, i), x)
                         .otherwise(F.lit(0.0)))
    return F.when(F.coalesce(F.size(allowed), F.lit(0)) > 0, masked).otherwise(p)


def top_k(p: Column, k: int = 3, allowed: Column | None = None,
          positive_only: bool = False) -> Column:
    """K4 (+P14): the ``k`` best (index, score) pairs, score desc, index asc, as
    ``ARRAY<STRUCT<i INT, score DOUBLE>>``; scores are read back from ``p`` so no ``-0.0``
    from the sort key leaks out."""
    cands = _candidates(p, allowed)
    if positive_only:
        cands = F.filter(cands, lambda z: z["k"] < 0)
    best = F.slice(F.array_sort(cands), 1, k)
    return F.transform(best, lambda z: F.struct(
        z["i"].cast("int").alias("i"), F.element_at(p, z["i"] + 1).alias("score")))


def l2_normalize(v: Column) -> Column:
    """divide by the Euclidean norm; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return _by_one(v, norm, lambda x, n: F.when(n > 0, x / n).otherwise(x.cast("double")))


def _by_one(v: Column, value: Column, f) -> Column:
    # a lambda that names ``value`` would evaluate it for every element; repeated beside the
    # vector it is evaluated once a row
    return F.zip_with(v, F.array_repeat(value, F.size(v)), f)


def softmax(v: Column) -> Column:
    """Probabilities from margins, in time linear in the number of classes."""
    e = _by_one(v, F.array_max(v), lambda x, top: F.exp(x - top))
    return _by_one(e, F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda x, s: x / s)
