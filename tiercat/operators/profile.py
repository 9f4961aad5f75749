"""Class-distribution profile.

Every statistic reads the class-count frame (one partially aggregated group-by per level),
never a per-class filter over the data (P7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tiercat.functions.text import prefix


def null_counts(df: DataFrame, cols) -> DataFrame:
    """Nulls per column, one pass, one row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).cast("long").alias(f"null_{c}")
                    for c in cols])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A1: ``(col, n)`` for non-null values; order with :func:`ranked_counts`."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n")))


def level_counts(df: DataFrame, levels) -> DataFrame:
    """``(level, label, n)`` of several label columns from one scan: one partially aggregated
    group-by on all of them, then sums of that small frame. A null label is a row of its own."""
    small = df.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("label"), "n") for c in levels]))
    return small.select(each.alias("z")).groupBy("z.level", "z.label").agg(F.sum("z.n").alias("n"))


def ranked_counts(counts: DataFrame, col: str) -> DataFrame:
    """A1/K1 order: count desc, name asc, as a 1-based ``rank`` (runs over class rows)."""
    w = Window.orderBy(F.col("n").desc(), F.col(col))
    return counts.withColumn("rank", F.row_number().over(w))


def _head(counts: DataFrame, k: int, order) -> DataFrame:
    # orderBy + limit plans a TakeOrderedAndProject (a per-task top-k, then a merge of
    # k rows per task); the rank window then runs over k rows only.
    limited = counts.orderBy(*order).limit(k)
    return limited.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_classes(counts: DataFrame, col: str, k: int = 20) -> DataFrame:
    """K1 head: the ``k`` largest classes (count desc, name asc) with a 1-based rank."""
    return _head(counts, k, (F.col("n").desc(), F.col(col)))


def bottom_classes(counts: DataFrame, col: str, k: int = 20) -> DataFrame:
    """K1 tail: the last ``k`` classes of the (count desc, name asc) order, ranked from the
    smallest."""
    return _head(counts, k, (F.col("n").asc(), F.col(col).desc()))


def distinct_classes(df: DataFrame, col: str) -> DataFrame:
    """A3 + A4: distinct values without nulls, and with null counted as one more class."""
    return df.agg(
        F.countDistinct(col).cast("long").alias("n_distinct"),
        (F.countDistinct(col) + F.max(F.col(col).isNull().cast("int"))).cast("long")
        .alias("n_distinct_with_null"))


def count_stats(counts: DataFrame) -> DataFrame:
    """A5: mean, exact median, min, max and sample standard deviation of class sizes."""
    return counts.agg(
        F.avg("n").alias("mean_n"), F.median("n").cast("double").alias("median_n"),
        F.min("n").cast("long").alias("min_n"), F.max("n").cast("long").alias("max_n"),
        F.stddev_samp("n").alias("std_n"))


def threshold_counts(counts: DataFrame, thresholds=(100, 50, 10)) -> DataFrame:
    """Number of classes below each threshold, and the number of classes."""
    return counts.agg(F.count(F.lit(1)).cast("long").alias("n_classes"),
                      *[F.count_if(F.col("n") < t).cast("long").alias(f"below_{t}")
                        for t in thresholds])


def imbalance_ratio(counts: DataFrame) -> DataFrame:
    """Largest over smallest class size."""
    return counts.agg((F.max("n") / F.min("n")).alias("imbalance_ratio"))


def sorted_labels(df: DataFrame, col: str) -> DataFrame:
    """K3: the distinct non-null labels with their 0-based position in sorted order."""
    names = df.where(F.col(col).isNotNull()).select(col).distinct()
    return names.withColumn("pos", F.row_number().over(Window.orderBy(col)) - 1)


def text_sample(df: DataFrame, text: str, key: str, k: int = 10, width: int = 80) -> DataFrame:
    """P6 + F16: the first ``k`` non-null texts by key, cut to ``width`` characters, and the
    number of non-null texts."""
    nonnull = df.where(F.col(text).isNotNull())
    head = nonnull.orderBy(key).limit(k).select(key, prefix(F.col(text), width).alias("sample"))
    total = nonnull.agg(F.count(F.lit(1)).alias("n_nonnull"))
    # a scalar subquery, so no join pairs the rows with the count
    return head.withColumn("n_nonnull", total.scalar())
