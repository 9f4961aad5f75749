"""Rows that share a key, null included, and hold different texts."""
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tiercat.llm import decontaminate, line_dedup, mixing, quality, simhash

SHARED = "one line that several of the texts hold"
ROWS = [
    (None, f"{SHARED}\nthe first null key goes on about apples"),
    (None, "a wholly unlike beginning of a text here\nthe second null key has its own pears"),
    (None, f"{SHARED}\nand this third text ends on some plums"),
    (None, f"nothing of it stands anywhere else at all\n{SHARED}"),
    (7, f"{SHARED}\nthe key seven says this only once"),
    (7, "unique opening words of the other seven\nunique closing words for it as well"),
    (7, f"{SHARED}\nwhich is a third text under key seven"),
    (7, f"{SHARED}\nwhich is a third text under key seven"),
    (8, f"{SHARED}\nkey eight stands on its own feet here"),
]


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_lines_of_texts_that_share_a_key(spark, broadcast_rows):
    d = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    gone = line_dedup.removed_lines(d, broadcast_rows=broadcast_rows).collect()
    # the shared line stays in one of the null keys' texts only, and no other line goes
    assert len(gone) == 6 and len({(r.key, r.tid) for r in gone if r.key is None}) == 2
    out = [(r.doc_id, r.text, r["n_removed"]) for r in line_dedup.dedup_lines(d).collect()]
    assert len(out) == len(ROWS) and sum(SHARED in t for _, t, _ in out) == 1
    assert sum(n for *_, n in out) == 6
    own = sorted(x for _, t in ROWS for x in t.split("\n") if x != SHARED)
    assert sorted(x for _, t, _ in out for x in t.split("\n") if x != SHARED) == own


def _text(seed):
    return " ".join(f"w{seed * 1000 + i}" for i in range(60))


def test_one_row_of_each_component(spark, tmp_path):
    rows = [(None, _text(1)), (None, _text(2)), (None, _text(2)), (None, _text(3)), (4, _text(3)),
            (5, _text(4)), (5, _text(5)), (5, _text(5)), (5, _text(3)), (6, _text(4)), (None, None), (None, "")]
    d = spark.createDataFrame([(*r, "en", "b", 0) for r in rows],
                              "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = [(None, _text(1)), (None, _text(2)), (4, _text(3)), (5, _text(4)), (5, _text(5)), (None, "")]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = corpus_pipeline.near_duplicate_stage(spark, d, str(tmp_path))
    assert got.columns == d.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=order) == sorted(want, key=order)
    assert sorted(((r.doc_id, r.text or "") for r in simhash.keep_one(d).collect()), key=order) == sorted(want, key=order)
    # one row a key: texts without a key all stay
    got = Counter(r.doc_id for r in simhash.keep_one(d, distinct_keys=True).collect())
    assert got == {None: 3, 4: 1, 5: 1}


def test_short_lines_that_repeat_go(spark, tmp_path):
    rows = [(1, "one line that two of the texts hold"), (2, "one line that two of the texts hold\nred\nblue green"),
            (3, "one line that two of the texts hold\n \t\n"), (4, "red\nblue  green\nshort"),
            (5, "blue green\nred\none line that two of the texts hold\n\nred"), (6, "red"), (7, "red\nred car"),
            (None, "one line that two of the texts hold"), (None, "one line that two of the texts hold\nof its own"),
            (8, "one line that two of the texts hold\nof its  own\n")]
    d = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")
    got = {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, d, str(tmp_path)).collect()}
    # 1, 3, 5, 6 and 8 hold copies only; one of the texts without a key has the first place
    assert {x for x in got if x[0]} == {(2, "red\nblue green", 14), (4, "short", 5), (7, "red car", 7)}
    null = {t for k, t, _ in got if k is None}
    assert len([t for t in null if "one line" in t]) == 1 and any("of its own" in t for t in null)


def test_lines_whose_first_hashes_collide(spark, monkeypatch):
    d = spark.createDataFrame([(1, f"{SHARED}\nred"), (2, "another line of as many of the words\nblue"),
                               (3, f"{SHARED}\nsome line that several of the texts hold\nblue")],
                              "doc_id long, text string").repartition(2)
    for name in ("first_hash", "second_hash"):
        with monkeypatch.context() as m:
            m.setattr(line_dedup, name, lambda w: F.lit(7).cast("long"))
            got = {(r.key, r.line) for r in line_dedup.removed_lines(d).collect()}
        assert got == {(3, 0), (3, 1), (3, 2)}


def test_texts_of_many_removed_lines(spark):
    lines = "\n".join(f"line {i}" for i in range(60_000))
    d = spark.createDataFrame([(1, lines), (2, lines + "\nand one more")], "doc_id long, text string")
    begin = time.time()
    out = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert out[1].text == lines and out[2].text == "and one more" and out[2].n_removed == 60_000
    assert time.time() - begin < 60


def test_blocks_of_a_benchmark_are_written_in_turn(spark, monkeypatch):
    written, write = [], decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, name: written.append(name) or write(df, name))
    items = spark.createDataFrame([(i, _text(10 + i)) for i in range(3)], "item_id long, text string")
    d = spark.createDataFrame([(i, f"before {_text(9 + i)} behind", "clash") for i in range(5)],
                              "doc_id long, text string, key string")
    out = decontaminate.keep_clean(d, items, block_chars=50)
    assert sorted(r.doc_id for r in out.collect()) == [0, 4] and len(written) == 2
    # the plan that is left holds one block
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_short_items_match_whole_words_only(spark):
    items = spark.createDataFrame([(1, "yes"), (2, "a"), (3, "42?"), (4, "deux mots")], "item_id long, text string")
    d = spark.createDataFrame([(1, "Yesterday man"), (2, "Oh, YES."), (3, "the answer is 42?!"), (4, "142? not"),
                               (5, "ces  deux\nmots-la"), (6, "deux motsx, eyes, yes"), (7, "b a")], "doc_id long, text string")
    got = {(r.key, r.item) for r in decontaminate.matches(d, items).collect()}
    assert got == {(2, 1), (3, 3), (5, 4), (6, 1), (7, 2), (4, 3)} - {(4, 3)}
    assert sorted(r.doc_id for r in decontaminate.keep_clean(d, items).collect()) == [1, 4]


def test_column_names_of_the_operators_clash_with_nothing(spark):
    names = ("__key", "__mix_key", "__mix_no", "__parts", "__gone", "__one_key", "n_lines", "n_removed", "row", "no", "copies",
             "tid", "sample_key", "h")
    rows = [(i, f"{SHARED}\nand of its own number {i % 4}\nand more {i}") for i in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")) \
        .select("*", *[F.lit("keepme").alias(n) for n in names])
    lab = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    lines = line_dedup.dedup_lines(d)
    assert lines.columns == d.columns + ["n_lines_", "n_removed_"] and lines.count() == 8
    for out in (lines, mixing.mix(d), simhash.keep_one(d), quality.keep_good(d, lab, threshold=0.0),
                decontaminate.keep_clean(d, lab.select("doc_id", F.lit("none of it").alias("text")), item="doc_id")):
        got = out.select(*names).distinct().collect()
        assert [tuple(r) for r in got] == [("keepme",) * len(names)]


def test_the_quality_stage_fits_what_classify_fits(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d = d.unionByName(d.limit(20)).unionByName(d.limit(10).withColumn("doc_id", F.lit(None).cast("long")))
    lab = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for most in (20_000, 30):
        want = Counter(r.key for r in quality.classify(d, lab, max_train_rows=most).where("predicted = 1").collect())
        got = Counter(r.doc_id for r in quality.keep_good(d, lab, max_train_rows=most).collect())
        assert got == want


def test_training_in_slices_keeps_every_token(spark, monkeypatch):
    from tiercat.llm import lm
    monkeypatch.setattr(lm, "SLICE", 500)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 2000")
    got = lm.scores(d, head_words=64, model_words=16, rare=8, classes=4, hidden=4).collect()
    assert len(got) == d.count() and all(r.score < 0 for r in got)


def test_the_mix_emits_the_planned_copies_of_repeated_rows(spark):
    rows = [(1, "a b c", "s")] * 7 + [(None, "", "s")] * 5 + [(None, "x y", "t")] * 6 + [(2, "a b c d", "s"), (2, "other", "t")] \
        + [(i, f"w {i}", "u") for i in range(10, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = Counter()
    for r in mixing.plan(d).collect():
        want[r.key, r.text_hash] += r.copies
    out = mixing.mix(d)
    assert out.columns == d.columns
    got = Counter((r.doc_id, r.h) for r in out.selectExpr("doc_id", "xxhash64(text) h").collect())
    assert got == +want and max(got[1, k] for i, k in got if i == 1) <= 14
