"""Registered queries of this subpackage: name -> (function, oracle SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tiercat.llm import (conversation, decontaminate, fingerprint, html_text, line_dedup, lm, merkle,
                         mixing, quality, simhash, sql, suffix_dedup, token_count, topk)
from tiercat.llm.common import stored
from tiercat.sources.io import read_table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    q = quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return q.withColumnRenamed("key", "doc_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that repeat."""
    d = suffix_dedup.dedup(read_table(spark, sf_dir, "documents"), length=400)
    return d.select(
        F.col("key").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    return lm.scores(read_table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    p = mixing.plan(read_table(spark, sf_dir, "documents"))
    return p.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target",
                    "copies", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without lines alike to earlier ones."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(d).select(
        "doc_id", "text", "n_lines", "n_removed")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: at a quarter of the text five
    characters are replaced, at a half words are put in, at three quarters twelve are dropped."""
    d = read_table(spark, sf_dir, "documents")
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    edits = F.array(*[
        F.struct(F.floor(n * share / 4).alias("at"), F.lit(drop).cast("long").alias("drop"),
                 F.coalesce(put, F.lit("")).alias("put"))
        for share, drop, put in ((1, 5, F.lit("x1 ")), (2, 0, F.concat(F.lit(" "), F.col("source"), F.lit(" "))),
                                 (3, 12, F.lit("")))])
    t = token_count.recount(d, edits)
    return t.select(F.col("key").alias("doc_id"), "n_pieces", "n_tokens", "n_after", "n_encoded")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    n = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return n.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    F.col("component").alias("component_id"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds."""
    m = decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return m.withColumnsRenamed({"key": "doc_id", "item": "item_id"})


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best integer products of every 50th vector."""
    return topk.search(read_table(spark, sf_dir, "embeddings"), query_every=50, k=5)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    t = html_text.main_text(read_table(spark, sf_dir, "pages"))
    return t.select(F.col("key").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least-cost repair and its audit of every conversation, after planted damage."""
    c = read_table(spark, sf_dir, "conversations")
    report, _ = conversation.repair(conversation.damaged(c), "conv")
    ids = c.select(F.col("conv_id").alias("conv_id")).distinct()
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n)
            for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(report, F.col("conv_id").eqNullSafe(F.col("key")), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that its leaf, or that of its
    tampered text, folds to."""
    d = read_table(spark, sf_dir, "documents")
    small = F.translate("text", merkle.UPPER, merkle.UPPER.lower())
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    altered = merkle.digest([F.when(tampered, small).otherwise(F.col("text")) if c == "text" else F.col(c)
                             for c in merkle.FIELDS])
    m = merkle.manifest(d, carry={"altered": altered})
    folded = merkle.folded(F.col("path"), F.col("altered"))
    return m.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root",
                    merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text edited by the next one, with their likeness, and
    the class of documents with fingerprints alike."""
    each = stored(fingerprint.against_edited(read_table(spark, sf_dir, "documents")), "fingerprints")
    return fingerprint.classes(each).select(
        F.col("key").alias("doc_id"), "n_chars", "edited_sha256",
        fingerprint.hex_digits(F.col("fp")).alias("fingerprint"),
        fingerprint.hex_digits(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprint.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "class_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_suffix_dedup, op3_lm_scores,
    op4_source_mixing, op5_line_dedup, op6_token_counts,
    op7_simhash, op8_decontamination, op9_topk, op10_html_text,
    op11_conversation_repair, op12_merkle_manifest, op13_fingerprints, pipeline)}

ORACLE_SQL = {name: text for name, text in sql.ORACLE.items() if name in QUERIES}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
