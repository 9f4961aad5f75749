"""Evaluation metrics (A14-A20, U1, K2, P13, M9, F10) as aggregations.

Everything is derived from the confusion counts ``groupBy(truth, prediction)``: one
partially aggregated pass over the scored rows, then work on at most classes² rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F



def _safe_div(num, den):
    # 0 on a zero denominator (zero_division=0), never an ANSI error
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    """Share of rows with prediction == truth."""
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """Confusion counts ``(y, p, n)`` (the matrix named in the reference's docstring)."""
    return df.groupBy(y, p).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, y: str, p: str, label: str = "label") -> DataFrame:
    """A15 + U1: per label of truth ∪ prediction: tp, support, predicted, precision,
    recall, f1 (0 on zero denominators)."""
    conf = confusion(df, y, p)
    sup = conf.groupBy(F.col(y).alias(label)).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0)).alias("tp"))
    prd = conf.groupBy(F.col(p).alias(label)).agg(F.sum("n").alias("predicted"))
    rep = sup.join(prd, label, "full_outer").select(
        label,
        F.coalesce("tp", F.lit(0)).cast("long").alias("tp"),
        F.coalesce("support", F.lit(0)).cast("long").alias("support"),
        F.coalesce("predicted", F.lit(0)).cast("long").alias("predicted"))
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    return (rep.withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                        F.col("precision") + F.col("recall"))))


def summary(report: DataFrame) -> DataFrame:
    """A16 + A17: macro precision/recall/F1 and support-weighted F1 over report rows."""
    return report.agg(
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        _safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"))


def evaluation(df: DataFrame, y: str, p: str) -> DataFrame:
    """M9: accuracy (sum of tp over all rows) and the macro/weighted summary, one row."""
    rep = class_report(df, y, p)
    return rep.agg(
        _safe_div(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        _safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"))


def joint_accuracy(df: DataFrame, y1: str, p1: str, y2: str, p2: str) -> DataFrame:
    """Share of rows where both levels are right."""
    ok = (F.col(y1) == F.col(p1)) & (F.col(y2) == F.col(p2))
    return df.agg(F.avg(ok.cast("double")).alias("joint_accuracy"))


def median_of(df: DataFrame, value: str, buckets: int = 65_536) -> DataFrame:
    """Exact median of a numeric column, one row, without gathering or sorting the column; nulls and NaN do
    not count.

    A selection by ranks: a pass counts the values in ``buckets`` equal steps between the least and the greatest
    value that are still open, and keeps each step's own least and greatest; the step that holds the
    middle ranks is the next range, until it holds one value. A pass narrows the range by 65,536 at least, so
    probabilities take four passes at most unless they are tiny; what a task or the driver holds are
    counters, however many values fall into one step."""
    m = _median(df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)"), buckets)
    return df.sparkSession.range(1).select(F.lit(m).cast("double").alias("median"))


def _median(v: DataFrame, buckets: int) -> float | None:
    total, low, high = v.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not total:
        return None
    first = (total + 1) // 2      # ranks of the two middle values, from 1
    second = (total + 2) // 2
    while low < high:
        width = high / buckets - low / buckets
        step = F.lit(0) if not width else F.least(
            F.lit(buckets - 1), F.floor((F.col("v") - low) / width)).cast("int")
        if not width:  # neighbouring numbers too close to divide: only the least, or not
            step = (F.col("v") > low).cast("int")
        hist = v.where(F.col("v").between(low, high)).groupBy(step.alias("s")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        up = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at = hist.withColumn("upto", F.sum("n").over(up)).where(
            (F.col("upto") >= first) & (F.col("upto") - F.col("n") < second)).orderBy("s").collect()
        if len(at) == 2:  # the two middle values stand on both sides of a border
            return (at[0].high + at[1].low) / 2
        before = at[0].upto - at[0].n
        first, second, low, high = first - before, second - before, at[0].low, at[0].high
    return low


def confidence_summary(df: DataFrame, prob: str) -> DataFrame:
    """A20 + F10: mean, exact median, min and max of the per-row maximum probability."""
    conf = df.select(F.array_max(F.col(prob)).alias("conf"))
    rest = conf.agg(F.avg("conf").alias("mean"), F.min("conf").alias("min"), F.max("conf").alias("max"))
    return rest.select("mean", median_of(conf, "conf").scalar().alias("median"), "min", "max")


def low_confidence(df: DataFrame, prob: str, threshold: float = 0.5) -> DataFrame:
    """Number and percentage of rows whose maximum probability is below threshold."""
    low = F.array_max(F.col(prob)) < threshold
    return df.agg(F.count_if(low).cast("long").alias("n_low"),
                  (_safe_div(F.count_if(low), F.count(F.lit(1))) * 100.0).alias("pct_low"))


def f1_extremes(report: DataFrame, name: str, k: int = 10) -> DataFrame:
    """K2: the ``k`` best and ``k`` worst classes by F1 (order f1 desc, name asc; the
    bottom list is the tail of that order), with support."""
    w_top = Window.orderBy(F.col("f1").desc(), F.col(name))
    w_bot = Window.orderBy(F.col("f1").asc(), F.col(name).desc())
    r = report.select(name, "f1", "support")
    top = (r.orderBy(F.col("f1").desc(), F.col(name)).limit(k)
           .withColumn("rank", F.row_number().over(w_top)).withColumn("which", F.lit("top")))
    bot = (r.orderBy(F.col("f1").asc(), F.col(name).desc()).limit(k)
           .withColumn("rank", F.row_number().over(w_bot)).withColumn("which", F.lit("bottom")))
    return top.unionByName(bot)
