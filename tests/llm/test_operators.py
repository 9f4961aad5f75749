"""Every operator on awkward rows, on empty tables, and against brute force."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_brute import near_components, removed_lines, repeated_bytes, semi_global
from tiercat.llm import (decontaminate, html_text, line_dedup, lm, mixing, quality, simhash, suffix_dedup,
                         token_count, topk)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 0), (6, 1, 0), (10, 0, 1), (12, None, 0), (None, 1, 1), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("key", F.lit("clash"))


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_quality(nasty, empty, labels):
    r = quality.classify(nasty, labels).collect()
    assert len(r) == nasty.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in r)
    assert {x.key: x.held_out for x in r}[1] == (zlib.crc32(b"1") % 5 == 0)
    assert quality.classify(empty, labels).count() == 0
    assert {x.score for x in quality.classify(nasty, labels.where("false")).collect()} == {0.5}
    kept = quality.keep_good(nasty, labels)
    assert kept.columns == nasty.columns
    good = Counter(x.key for x in r if x.predicted)
    assert Counter(x.doc_id for x in kept.select("doc_id").collect()) == good


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{d}/labels.parquet")
    r = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), lab)
    got = r.join(lab, r.key == lab.doc_id).where("held_out").select("predicted", "quality").collect()
    assert len(got) > 50 and sum(x.predicted == x.quality for x in got) / len(got) > 0.95


def _suffix_rows(df, length, **more):
    out = suffix_dedup.dedup(df, length=length, **more)
    return sorted((x.key is None, x.key, x.n_bytes, sum(s.end - s.first for s in x.removed), len(x.removed),
                   hashlib.sha256(bytes(x.kept)).hexdigest()) for x in out.collect())


@pytest.mark.parametrize("more", [{}, {"most_classes": 2}])
def test_suffix_dedup(nasty, more):
    rows = [(r.doc_id, (r.text or "").encode()) for r in nasty.select("doc_id", "text").collect()]
    for length, anchors in ((24, (6, 12, 20)), (400, (64, 240, 340))):
        assert _suffix_rows(nasty, length, anchors=anchors, **more) == repeated_bytes(rows, length)


def test_suffix_dedup_on_documents(small, empty):
    rows = [(r.doc_id, r.text.encode()) for r in small.collect()]
    assert _suffix_rows(small, 400) == repeated_bytes(rows, 400)
    assert suffix_dedup.dedup(empty).count() == 0


def test_lm(nasty, empty, small):
    for d in (nasty, small):
        rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""])
                for r in d.select("doc_id", "text").collect()]
        c = Counter()
        for k, w in rows:
            if zlib.crc32(str(k if k is not None else "").encode()) % 5 != 1:
                c.update(w)
        total, types = sum(c.values()), len(c)
        want = sorted((k is None, k, len(w), sum(c[x] > 0 for x in w), total,
                       round(sum(math.log10((c[x] + .5) / (total + .5 * (types + 1))) for x in w), 4)) for k, w in rows)
        got = lm.scores(d, head_words=64, model_words=16, rare=8, classes=4, hidden=4).collect()
        assert want == sorted((r.key is None, r.key, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))
                              for r in got)
        assert all(r.score < 0 for r in got)
    held = [r for r in lm.scores(small).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.scores(empty).count() == 0


def test_mix(nasty, empty, small):
    for d in (nasty, small):
        p = mixing.plan(d)
        r = p.collect()
        assert len(r) == d.count()
        sizes = defaultdict(int)
        for x in d.select("source", "text").collect():
            sizes[x.source] += len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        target, capped = {}, set()
        while True:  # deal, cap, deal the excess again
            left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
            free = [s for s in names if s not in capped]
            target = {s: 2.0 * sizes[s] for s in capped} | {
                s: left * w[s] / sum(w[x] for x in free) for s in free}
            over = {s for s in free if target[s] > 2 * sizes[s]}
            if not over:
                break
            capped |= over
        taken, most = defaultdict(int), defaultdict(int)
        for x in r:
            assert x.taken <= 2 * x.size and x.source_size == sizes[x.source]
            assert abs(x.target - target[x.source]) < 1e-6 * max(1, x.target)
            taken[x.source] += x.taken
            most[x.source] = max(most[x.source], x.size)
        assert all(abs(taken[s] - target[s]) <= most[s] + 1e-6 for s in names)
        again = Counter(tuple(x) for x in mixing.plan(d.repartition(5)).collect())
        assert again == Counter(tuple(x) for x in r)
        m = mixing.mix(d)
        assert m.columns == d.columns
        assert Counter(x.doc_id for x in m.select("doc_id").collect()) == \
            Counter({k: n for k, n in _sum((x.key, x.copies) for x in r).items() if n})
    assert mixing.mix(empty).count() == 0 and mixing.plan(empty).count() == 0


def _sum(pairs):
    out = Counter()
    for k, n in pairs:
        out[k] += n
    return out


def test_line_dedup(nasty, empty, small):
    for d, kw in ((nasty, {}), (nasty, {"broadcast_rows": 0}), (small, {})):
        rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
        want = Counter(removed_lines(rows, 5))
        got = line_dedup.removed_lines(d, **kw)
        assert Counter((r.key, r.line) for r in got.collect()) == want
    out = line_dedup.dedup_lines(nasty)
    assert out.columns == nasty.columns + ["n_lines", "n_removed"]
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[3] is None and texts[4] == "" and texts[5] == "   \n\t "
    assert texts[2] == "alpha beta gamma delta epsilon" and texts[1] == "short line\n" or texts[1] is not None
    assert out.count() == nasty.count() and line_dedup.dedup_lines(empty).count() == 0


def test_lines_within_one_word(spark):
    base = "a b c d e f g h".split()
    texts = [" ".join(base)]
    for i in range(8):
        texts.append(" ".join(base[:i] + ["X"] + base[i + 1:]))
        texts.append(" ".join(base[:i] + base[i + 1:]))
        texts.append(" ".join(base[:i] + ["Y"] + base[i:]))
    texts += ["b a c d e f g h", "c d e f g h a b", "a b c X e Y g h", "h g f e d c b a", "p q r s"]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    for shuffled in (rows, [(100 - i, t) for i, t in rows]):
        d = spark.createDataFrame(shuffled, "doc_id long, text string")
        got = {r.key for r in line_dedup.removed_lines(d).collect()}
        assert got == {k for k, _ in removed_lines(shuffled, 5)}


def test_token_counts(nasty, empty):
    edits = F.array(F.struct(F.lit(5).alias("at"), F.lit(3).alias("drop"), F.lit(" new ").alias("put")),
                    F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("drop"), F.lit("Start").alias("put")))
    c = token_count.Counter(token_count.ranks_of(token_count.VOCABULARY))
    size = lambda t: len(c.encoding.encode_ordinary(t))
    want = []
    for r in nasty.select("doc_id", "text").collect():
        t = r.text or ""
        u = "Start" + t[:5] + " new " + t[8:] if len(t) >= 5 else "Start" + t + " new "
        want.append((r.doc_id is None, r.doc_id, size(t), size(u)))
    got = [(r.key is None, r.key, r.n_tokens, r.n_after) for r in token_count.recount(nasty, edits).collect()]
    assert sorted(got) == sorted(want)
    assert token_count.recount(empty, edits).count() == 0
    none = token_count.recount(nasty, F.lit(None)).where("n_tokens <> n_after OR n_encoded <> 0")
    assert none.count() == 0


def test_simhash(nasty, empty, small, spark):
    for d in (nasty, small):
        rows = [(r.doc_id, (r.text or "").encode()) for r in d.select("doc_id", "text").collect()]
        want = near_components([(k, simhash.fingerprint(t)) for k, t in rows], 3)
        got = Counter((r.key, r.fp & (2 ** 64 - 1), r.component) for r in simhash.near_duplicates(d).collect())
        assert got == want
    kept = simhash.keep_one(nasty, distinct_keys=True)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == nasty.columns and len(ids) == len(set(ids)) and 4 not in ids and 5 not in ids and 3 in ids
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_simhash_dense_cluster_in_blocks(spark):
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 62, 3, dtype=np.uint64)
    fps = {int(c) for c in centre}
    for c in centre:
        for _ in range(150):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {k: c for k, _, c in near_components(list(zip(range(len(fps)), fps)), 3)}
    for block in (16, 2048):
        from tiercat.llm.components import components
        root = {r.node: r.root for r in components(simhash.links(nodes, 3, block)).collect()}
        groups = defaultdict(set)
        for i, f in enumerate(signed):
            groups[root.get(f, f)].add(i)
        expected = defaultdict(set)
        for i in range(len(fps)):
            expected[want[i]].add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_decontamination(spark, nasty, empty, small):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(6).collect()
    extra = [(900, None), (901, "  "), (902, "one two  THREE four five six"), (902, "one two  THREE four five six")]
    items = spark.createDataFrame([(r.item_id, r.text) for r in bench] + extra, "item_id long, text string")
    planted = [(5000, "Intro. " + bench[0].text.upper().replace(" ", "\n ") + " end"),
               (5001, "x " + bench[1].text[:50] + "#" + bench[1].text[51:] + " y"), (5002, bench[2].text[:40])]
    short = small.where("length(text) < 700").select("doc_id", "text")
    docs = short.unionByName(nasty.where("length(text) < 700 OR text IS NULL").select("doc_id", "text")) \
        .unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    want = Counter()
    for d in docs.collect():
        t = decontaminate.normal((d.text or "").encode())
        for i in items.collect():
            p = decontaminate.normal((i.text or "").encode())
            k = semi_global(p, t) if p and t else None
            if k is not None and k <= int(len(p) * 0.05):
                want[d.doc_id, i.item_id, k] += 1
    assert {(5000, bench[0].item_id, 0), (5001, bench[1].item_id, 1)} <= set(want)
    for chars in (1_000_000, 300):  # one block, several blocks
        got = decontaminate.matches(docs, items, block_chars=chars)
        assert Counter((r.key, r.item, r.distance) for r in got.collect()) == want
        kept = decontaminate.keep_clean(nasty, items, block_chars=chars)
        assert kept.columns == nasty.columns
        held = "one two three four five six"  # the only item among these rows
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
            (r.doc_id, r.text) for r in nasty.collect()
            if held not in decontaminate.normal((r.text or "").encode()))
    assert decontaminate.matches(empty, items).count() == 0
    assert decontaminate.matches(docs, items.where("false")).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [1.0, float("nan"), 0.0, 0.0]), (250, [float("inf")] * 4),
             (300, [0.5, 0.5, 0.5, 0.5]), (301, [0.5, 0.5, 0.5, 0.5]), (302, [0.5, 0.5, 0.5, 0.5]), (350, []),
             (400, [1.0, 2.0]), (401, [3.0, 1.0]), (450, [1e12, 1.0, -1e12, 0.0]), (500, [0.0] * 4), (None, [1.0] * 4),
             (100, [0.1, 0.2, 0.3, 0.4])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for n, (q, v) in enumerate(ok):
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(u, v)), i) for j, (i, u) in enumerate(ok)
                       if j != n and len(u) == len(v))[:5]
            want.update((q, r + 1, i, -x) for r, (x, i) in enumerate(s))
    for bucket, block in ((4096, 512), (7, 2)):
        got = topk.search(d, bucket_rows=bucket, query_rows=block)
        assert Counter(tuple(r) for r in got.collect()) == want
    assert topk.search(d.where("false")).count() == 0
    huge = spark.createDataFrame([(0, [1e16, 1.0]), (1, [1e16, 0.0]), (2, [-1e16, 0.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.search(huge).collect()}
    assert got == {(0, 1): 2 ** 63 - 1, (0, 2): -2 ** 63}


def test_html(spark):
    page = "<html><body><div class='menu'>m</div><article><h1>T%d</h1><p>text of page %d &eacute;</p></article></body>"
    rows = [(i, f"http://Host.example/{i}", page % (i, i)) for i in range(20)]
    rows += [(30, None, page % (30, 30)), (31, "no host", "<p>alone"), (32, "http://host.example/x", None),
             (33, "http://host.example/y", ""), (33, "http://host.example/y", ""), (None, "https://u@b.example:8/", "<p>x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")) \
        .withColumn("host", F.lit("clash"))
    for paths in (200_000, 0):
        got = Counter((r.key, r.text) for r in html_text.main_text(d, broadcast_paths=paths).collect())
        want = Counter([(i, f"T{i}\ntext of page {i} é") for i in [*range(20), 30]]
                       + [(31, "alone"), (32, ""), (33, ""), (33, ""), (None, "x")])
        assert got == want
    assert html_text.main_text(d.where("false")).count() == 0
