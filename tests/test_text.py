"""Text analysis and TF-IDF against a pure-Python vectorizer written from the definition."""

import math
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from tiercat.functions import text as tx
from tiercat.operators import tfidf
from tiercat.plans import fixtures as fx

from folders import SF_SMALL

WORD = re.compile(r"(?u)\b\w+\b")


def py_norm(s):
    s = s.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def py_terms(s):
    t = WORD.findall(py_norm(s))
    return t + [f"{a} {b}" for a, b in zip(t, t[1:])]


def test_normalize_tokens_ngrams_match_python(spark):
    df = fx.txn(spark, SF_SMALL).select("doc_id", "clean_description")
    extra = spark.createDataFrame(
        [(-1, "Ĳssel ﬁnal Straße café ½ Ærø ŉ"), (-2, "déjà-vu_x 12 ÉTÉ")],
        "doc_id long, clean_description string")
    rows = (df.unionByName(extra)
            .select("doc_id", "clean_description",
                    tx.normalize_text(F.col("clean_description")).alias("n"),
                    tx.analyzed_terms(F.col("clean_description")).alias("g")).collect())
    for r in rows:
        assert r.n == py_norm(r.clean_description), r.doc_id
        assert list(r.g) == py_terms(r.clean_description), r.doc_id


def py_tfidf(docs, min_df, max_features):
    tfs = {k: Counter(py_terms(t)) for k, t in docs.items()}
    df = Counter(term for c in tfs.values() for term in c)
    total = Counter()
    for c in tfs.values():
        total.update(c)
    cand = [t for t in df if df[t] >= min_df]
    cand.sort(key=lambda t: (-total[t], t))
    vocab = set(cand[:max_features])
    n = len(docs)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    out = {}
    for k, c in tfs.items():
        w = {t: (1 + math.log(v)) * idf[t] for t, v in c.items() if t in vocab}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            out[(k, t)] = x / norm
    return vocab, out


def test_tfidf_with_vocabulary_cap_matches_python(spark):
    txn = fx.txn(spark, SF_SMALL).select("doc_id", "clean_description")
    docs = {r.doc_id: r.clean_description for r in txn.collect()}
    tf = tfidf.term_frequencies(txn, "doc_id", "clean_description")
    for cap in (None, 500):
        model = tfidf.fit(tf, len(docs), min_df=3, max_features=cap)
        vocab, want = py_tfidf(docs, 3, cap or 10**9)
        got_vocab = {r.term for r in model.vocab.select("term").collect()}
        assert got_vocab == vocab
        got = {(r.doc_id, r.term): r.weight for r in model.weights(tf, "doc_id").collect()}
        assert got.keys() == want.keys()
        assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    idx = sorted((r.term_idx, r.term) for r in model.vocab.collect())
    assert [t for _, t in idx] == sorted(vocab)


def test_type_feature(spark):
    vals = [None, "", " Credit", "DEBIT", "credit/debit", "other"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [r.f for r in df.select(tx.type_feature(F.col("t")).alias("f")).collect()]
    assert got == [0.0, 0.0, 1.0, -1.0, 1.0, 0.0]


def test_accents_of_all_scripts(spark):
    import unicodedata
    texts = ["ｆｕｌｌ　ｗｉｄｔｈ", "™ ① ⁴ ½ ﬁ", "がぎ パピ カナ", "한국어 값", "مُحَمَّد", "Crème Brûlée Ǆ", "plain", "", "𝔘𝔫𝔦 𝟙",
             "한e\u0301", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in d.select("i", tx.strip_accents(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = t and "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        assert got[i] == want, (t, got[i], want)


def test_words_of_documents_give_the_counts_of_the_long_form(spark, monkeypatch):
    import pyarrow as pa
    texts = ["a b a b", "b  c", None, "", "...", "Été b", "a b a b c"] * 3
    rows = [(i % 8 if i != 5 else None, i % 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "k int, y int, t string")
    tf = tfidf.term_frequencies(docs, "k", "t", ["y"])
    words = tfidf.word_lists(docs, "k", "t", ["y"], 3).cache()
    for cap, slice_bytes, broadcast in ((None, 8, 1 << 20), (3, 1 << 20, 1 << 20), (None, 1 << 20, 0)):
        monkeypatch.setattr(tfidf, "SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(tfidf, "BROADCAST_BYTES", broadcast)
        old = tfidf.fit(tf, 21, 2, cap)
        new = tfidf.fit_words(words, 21, 2, cap, partitions=3)
        assert sorted(map(tuple, new.vocab.collect())) == sorted(map(tuple, old.vocab.collect())) and new.size == old.size
        some = lambda d: {(r.k, r.y): [(t.term_idx, t.tf, round(t.weight, 9)) for t in r.terms] for r in d.collect()}
        got, want = new.rows_of(words, "k", ["y"]), old.rows(tf, "k", ["y"])
        assert some(got) == some(want) and got.count() == want.count() > 0
        pairs = lambda d: sorted(map(str, d.select("k", "y", "term", "tf").collect()))
        assert pairs(new.presence(got)) == pairs(old.presence(tf))
    row, code, tf3, terms = tfidf.gram_counts(pa.array(["x y \n x y z", None, "x"]), 1, 3)
    assert sorted((int(r), terms[int(c)].as_py(), int(n)) for r, c, n in zip(row, code, tf3)) == sorted([
        (0, "x", 2), (0, "y", 2), (0, "z", 1), (0, "x y", 2), (0, "y z", 1), (0, "x y z", 1), (2, "x", 1)])
    assert len(tfidf.gram_counts(pa.array([], pa.string()), 1, 2)[0]) == 0


def test_counting_writes_no_row_a_document_and_term(spark):
    from test_plans import plan
    words = tfidf.word_lists(fx.txn(spark, SF_SMALL).select("doc_id", "clean_description"), "doc_id", "clean_description", (), 4)
    text = plan(words)
    assert "Generate" not in text and text.count("Exchange hashpartitioning") == 1
    assert "term-frequencies" not in plan(fx.text_features(spark, SF_SMALL).weights("train"))


def test_a_sketch_loses_no_term_of_the_vocabulary(spark, monkeypatch):
    import random
    r = random.Random(4)
    texts = [" ".join(f"w{int(r.paretovariate(.6)) % 900}" for _ in range(40)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    words = tfidf.word_rows(docs, "k", "t", (), 3).cache()
    want = {x: tfidf.fit_words(words, 400, *x) for x in ((2, 150), (10, 150), (2, 10**6), (3, None), (1, 30))}
    counted, real = [], tfidf._counted
    monkeypatch.setattr(tfidf, "_counted", lambda *a: counted.append(real(*a)) or counted[-1])
    monkeypatch.setattr(tfidf, "SKETCH_BYTES", 0)
    monkeypatch.setattr(tfidf, "MERGE_ROWS", 500)
    monkeypatch.setattr(tfidf, "SLICE_BYTES", 3000)
    for x, m in want.items():
        got = tfidf.fit_words(words, 400, *x, partitions=3)
        assert sorted(map(tuple, got.vocab.collect())) == sorted(map(tuple, m.vocab.collect())) and got.size == m.size > 0
    # rare terms were not counted
    assert counted[0].count() < real(words, 1, 2, None, None).count() / 2
    # a threshold that too few terms reach is lowered
    monkeypatch.setattr(tfidf.Sketch, "threshold", lambda self, counters: 300 if counters < 4000 else 1)
    counted.clear()
    got = tfidf.fit_words(words, 400, 2, 150)
    assert len(counted) > 1 and sorted(map(tuple, got.vocab.collect())) == sorted(map(tuple, want[2, 150].vocab.collect()))
    # nothing to count
    assert tfidf.fit_words(words.where("false"), 0, 2, 10).size == 0


def test_only_texts_whose_key_repeats_are_shuffled(spark):
    from test_plans import plan
    rows = [(1, 0, "a b"), (2, 1, "b  c"), (3, 0, None), (None, 1, "c")]
    docs = spark.createDataFrame(rows, "k int, y int, t string")
    alone = tfidf.word_rows(docs, "k", "t", ["y"], 3)
    assert "Exchange" not in plan(alone)
    more = spark.createDataFrame([*rows, (2, 1, "d"), (3, 1, "e"), (None, 1, "f"), (None, 0, "f")], "k int, y int, t string")
    some = tfidf.word_rows(more, "k", "t", ["y"], 3)
    for d, n in ((alone, docs), (some, more)):
        assert sorted(map(str, d.select("k", "y", "words").collect())) == sorted(
            map(str, tfidf.word_lists(n, "k", "t", ["y"], 3).collect()))
    assert {(r.k, r.y): (r.copies, r.again) for r in some.collect()} == {
        (1, 0): (1, False), (2, 1): (2, True), (3, 0): (1, True), (3, 1): (1, True), (None, 1): (2, True), (None, 0): (1, True)}


def test_stored_counts_give_the_rows_of_the_feature_table(spark, monkeypatch, tmp_path):
    from tiercat.operators import train as tr
    rows = [(i, i % 3, f"a{i % 4} b{i % 5} c a{i % 4}", "train" if i % 4 else "val") for i in range(40)]
    rows += [(7, 1, "a1 c", "train"), (7, 2, "zz b3", "train"), (8, 2, "", "val"), (None, 1, "a1 b1", "train"), (99, 0, "q", "val")]
    for more in ([], [(None, 2, "a1 b1", "train"), (50, 0, "q", "val"), (50, 0, "p", "val")]):
        d = spark.createDataFrame(rows[:40] + rows[44:] + more if not more else rows + more,
                                  "doc_id long, category_id int, clean_description string, split string") \
            .withColumn("subcategory_id", F.col("category_id") + 1)
        words = tfidf.word_rows(d, "doc_id", "clean_description", fx.CARRY, 3).cache()
        model = tfidf.fit_words(words, 40, 2)
        carry = [*fx.CARRY, "copies", "again"]
        want = None
        for most in (1 << 20, 0):
            monkeypatch.setattr(tfidf, "BROADCAST_BYTES", most)
            f = fx.TextFeatures(fx.Prepared(d, None, None), model, model.sparse_of(words, "doc_id", carry).cache(), 3)
            if want is None:
                docs = d.select("doc_id", "category_id", "subcategory_id", "split")
                path = str(tmp_path / f"f{len(more)}")
                t = tr.feature_table(docs, f.rows, "doc_id", model.size, path)
                want = tr.read_rows(spark, path, t.schema)
            same = lambda x: sorted((str(r.doc_id), r.category_id, r.subcategory_id, r.split, tuple(r.indices),
                                     tuple(round(v, 12) for v in r["values"])) for r in x.collect())
            assert same(model.valued(f.documents())) == same(want)
    assert f.repeated and f.documents().count() == want.count() > d.count()
