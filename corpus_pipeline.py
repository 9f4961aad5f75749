"""The corpus pipeline: five stages, each one operator of ``tiercat.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame with the columns of ``documents`` (the last one too, with repeated rows). ``run``
applies them in order, every stage's result written as Parquet and read again.

Rows whose key repeats and rows with null columns pass through every stage by the rules that
the operators' modules state.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from tiercat.llm import decontaminate, line_dedup, mixing, quality, simhash  # noqa: E402
from tiercat.llm.common import col, stored  # noqa: E402
from tiercat.sources.io import read_table  # noqa: E402

# The classifier cannot be written in SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None

# Shorter lines go only where they repeat an earlier line exactly.
MIN_WORDS = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.3) go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines alike to an earlier line go, and with them the texts of which nothing but blank lines is
    left; n_chars follows the text. Texts that lose nothing stay."""
    d = line_dedup.dedup_lines(docs, min_words=MIN_WORDS, drop_copies=True)
    lost = col(d.columns[-1]) > 0
    new = F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return d.select(*[new.alias(c) if c == "n_chars" else col(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; documents
    that share an id, or have none, are told apart by their texts."""
    return simhash.keep_one(docs, shingle=3, max_bits=3, distinct_keys=False)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at weights 3, 1, 2, of 150 % of all words."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
