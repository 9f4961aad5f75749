"""The pipeline against a plain version of its five stages, on whole small tables."""
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_brute import near_components, removed_lines, semi_global
from tiercat.llm import decontaminate, gam, mixing, quality, simhash

SMALL = "/root/testdata/sf0.001"


def _words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def _plain(docs, labels, bench):
    """docs: {doc_id: (text, lang, source)} with distinct ids."""
    import zlib
    # quality: the same statistics and fit, scored one by one
    x = {k: np.array(quality.features((t or "").encode()), np.float32).astype(float) for k, (t, *_) in docs.items()}
    signed = lambda k: xxhash.xxh64(k.to_bytes(8, "little", signed=True), 42).intdigest()
    learn = [(k, y) for k, y in labels if k in x and zlib.crc32(str(k).encode()) % 5]
    learn.sort(key=lambda p: signed(p[0]) - (signed(p[0]) >> 63 << 64))
    model = gam.fit(np.array([x[k] for k, _ in learn]), np.array([float(y) for _, y in learn]))
    docs = {k: d for k, d in docs.items() if model.probability(x[k][None])[0] >= 0.3}
    # lines
    gone = defaultdict(set)
    for k, i in removed_lines([(k, d[0]) for k, d in docs.items()], 5):
        gone[k].add(i)
    for k, lines in gone.items():
        t = "\n".join(p for i, p in enumerate(docs[k][0].split("\n")) if i not in lines)
        docs[k] = (t, *docs[k][1:])
    docs = {k: d for k, d in docs.items()
            if k not in gone or _words(d[0])}
    # near copies
    comp = near_components([(k, simhash.fingerprint((d[0] or "").encode())) for k, d in docs.items()], 3)
    docs = {k: docs[k] for k, _, c in comp if k == c}
    # benchmark passages
    items = [decontaminate.normal(t.encode()) for t in bench]
    texts = {k: decontaminate.normal((d[0] or "").encode()) for k, d in docs.items()}
    docs = {k: d for k, d in docs.items()
            if not any(semi_global(p, texts[k]) <= int(len(p) * 0.05) for p in items)}
    return docs


def test_pipeline(spark, tmp_path):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 2500")
    base = [tuple(r) for r in d.collect()]
    bench = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(5).collect()]
    more = [(9000, "Before it. " + bench[0] + "\nAnd a line of its own after it.", "en", "src1", 0),
            (9001, base[0][1], "en", "src1", 0), (9002, base[1][1] + " tail", None, None, 0),
            (9003, None, "en", "src2", 0), (9004, "", "en", "src2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(base + more, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string") \
        .write.parquet(str(tmp_path / "benchmark.parquet"))
    lab = spark.read.parquet(f"{SMALL}/labels.parquet")
    lab.write.parquet(str(tmp_path / "labels.parquet"))

    labels = [(r.doc_id, r.quality) for r in lab.collect()]
    want = _plain({r[0]: (r[1], r[2], r[3]) for r in base + more}, labels, bench)
    assert 9000 not in want and 9001 not in want and len(want) > 20
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    copies = Counter(r.doc_id for r in out.collect())
    assert {r.doc_id: r.text for r in out.collect()}.items() <= {k: v[0] for k, v in want.items()}.items()
    # the mix of what is left: every source near its target, nothing more than twice
    left = spark.createDataFrame([(k, *v) for k, v in want.items()], "doc_id long, text string, lang string, source string")
    plan = {r.key: r.copies for r in mixing.plan(left).collect()}
    assert copies == Counter({k: n for k, n in plan.items() if n}) and max(copies.values()) <= 2
    total = sum(_words(v[0]) for v in want.values())
    assert 1.2 * total < sum(_words(want[k][0]) * n for k, n in copies.items()) < 1.8 * total


def test_stages_keep_the_columns(spark, nasty, empty, tmp_path):
    lab = spark.createDataFrame([(1, 1), (2, 1), (10, 1)], "doc_id long, quality int")
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing like it")], "item_id long, text string") \
        .write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    for docs in (nasty, empty):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert out.where(F.col("n_chars").isNotNull()).count() <= 2 * docs.count()


def test_entry_names():
    import __spark_entry__ as e
    names = set(e.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_|", n)[0] for n in names}
    assert "op5_line_dedup" in e.oracle_sql() and "op4_source_mixing" in e.oracle_sql()
