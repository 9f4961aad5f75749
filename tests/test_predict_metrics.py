"""Masked prediction properties and metrics against brute force."""

import random

from pyspark.sql import functions as F

from tiercat.functions.arrays import argmax, masked_argmax, top_k
from tiercat.operators import metrics as mt
from tiercat.operators import predict as pd_


def test_masked_argmax_properties(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        p = [rnd.choice([0.0, 0.1, 0.2, 0.5, 0.7]) for _ in range(8)]
        allowed = None if i % 10 == 0 else ([] if i % 10 == 1 else
                                             sorted(rnd.sample(range(8), rnd.randint(1, 4))))
        rows.append((i, p, allowed))
    df = spark.createDataFrame(rows, "id int, p array<double>, a array<int>")
    out = df.select("id", "p", "a", argmax(F.col("p")).alias("am"),
                    masked_argmax(F.col("p"), F.col("a")).alias("m"),
                    top_k(F.col("p"), 3, F.col("a"), positive_only=True).alias("t")).collect()
    for r in out:
        cand = list(range(8)) if not r.a else r.a
        best = min(cand, key=lambda j: (-r.p[j], j))
        assert r.m == best
        assert r.am == min(range(8), key=lambda j: (-r.p[j], j))
        if r.am in cand:
            assert r.m == r.am
        want = sorted((j for j in cand if r.p[j] > 0), key=lambda j: (-r.p[j], j))[:3]
        assert [z.i for z in r.t] == want


def test_allowed_ids_outside_or_repeated(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5], [9, 2, 2, -1]), ([0.2, 0.5, 0.5], [7])],
                               "p array<double>, a array<int>")
    r = df.select(masked_argmax(F.col("p"), F.col("a")).alias("m"), top_k(F.col("p"), 3, F.col("a")).alias("t")).collect()
    assert [x.m for x in r] == [2, None]
    assert [[z.i for z in x.t] for x in r] == [[2], []]


def test_classify_names_every_row(spark):
    """Names by joins: rows stay whole and in order of score; a class without a name, and a row
    without probabilities, has the name null."""
    cats = spark.createDataFrame([("a", 0), ("b", 1)], "category string, category_id int")
    subs = spark.createDataFrame([("a/x", 0), ("b/x", 1), ("b/y", 2)], "sub_category string, subcategory_id int")
    cmap = spark.createDataFrame([(0, [0]), (1, [1, 2])], "category_id int, sub_ids array<int>")
    rows = [(1, [0.1, 0.6, 0.3], [0.5, 0.2, 0.3]), (2, [0.7, 0.2, 0.1], [0.0, 0.9, 0.1]),
            (3, [0.1, 0.2, 0.7], [0.5, 0.2, 0.3]), (4, None, None), (2, [0.7, 0.2, 0.1], [0.0, 0.9, 0.1])]
    df = spark.createDataFrame(rows, "id int, cat_prob array<double>, sub_prob array<double>")
    got = pd_.classify(df, cmap, cats, subs, k=2).orderBy("id").collect()
    assert [(r.id, r.category, r.subcategory) for r in got] == [
        (1, "b", "b/y"), (2, "a", "a/x"), (2, "a", "a/x"), (3, None, "a/x"), (4, None, None)]
    top = lambda z, name: None if z is None else [(x[name], x.confidence) for x in z]
    assert [top(r.top_categories, "category") for r in got] == [
        [("b", 0.6), (None, 0.3)], [("a", 0.7), ("b", 0.2)], [("a", 0.7), ("b", 0.2)],
        [(None, 0.7), ("b", 0.2)], None]
    assert [top(r.top_subcategories, "subcategory") for r in got] == [
        [("b/y", 0.3), ("b/x", 0.2)], [], [], [("a/x", 0.5), ("b/y", 0.3)], None]


def test_class_report_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 5), rnd.randint(0, 6)) for _ in range(500)]
    df = spark.createDataFrame(rows, "y int, p int")
    rep = {r.label: r for r in mt.class_report(df, "y", "p").collect()}
    labels = {y for y, _ in rows} | {p for _, p in rows}
    assert set(rep) == labels
    f1s, sup = [], []
    for c in labels:
        tp = sum(1 for y, p in rows if y == c and p == c)
        s = sum(1 for y, _ in rows if y == c)
        pr = sum(1 for _, p in rows if p == c)
        prec = tp / pr if pr else 0.0
        rec = tp / s if s else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        assert abs(rep[c].f1 - f1) < 1e-12 and rep[c].support == s
        f1s.append(f1)
        sup.append(s)
    ev = mt.evaluation(df, "y", "p").first()
    assert abs(ev.f1_macro - sum(f1s) / len(f1s)) < 1e-12
    assert abs(ev.f1_weighted - sum(f * s for f, s in zip(f1s, sup)) / len(rows)) < 1e-12
    assert abs(ev.accuracy - sum(y == p for y, p in rows) / len(rows)) < 1e-12


def test_exact_median_without_gathering(spark):
    import random
    import statistics

    from pyspark.sql import functions as F

    from tiercat.operators.metrics import median_of
    rnd = random.Random(5)
    for values in ([], [0.5], [0.0, 1.0], [0.25] * 9 + [0.75], [rnd.random() for _ in range(501)],
                   [round(rnd.random(), 1) for _ in range(400)]):
        d = spark.createDataFrame([(v,) for v in values], "c double")
        for buckets in (4, 65_536):
            got = median_of(d, "c", buckets).first()[0]
            assert got == (statistics.median(values) if values else None)
    plan = median_of(spark.range(10).select((F.col("id") / 10).alias("c")), "c")._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_exact_median_of_crowded_values(spark):
    """Confident models: all values in one step of a coarse histogram, ties, neighbours, tiny and huge values."""
    import random
    import statistics
    from tiercat.operators.metrics import median_of
    r = random.Random(4)
    near = [1 - r.random() * 1e-6 for _ in range(999)]
    for values in (near, near + [0.0], [1 - 2**-53, 1.0], [1.0] * 7 + [0.5], [5e-324, 1e-300, 0.0, 1.0],
                   [-3.0, 1e308, -1e308, 2.0], [2.0 ** -i for i in range(200)]):
        d = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "c double")
        assert median_of(d, "c").first()[0] == statistics.median(values)
        assert median_of(d, "c", 4).first()[0] == statistics.median(values)


def test_names_in_place_equal_names_by_joins(spark, monkeypatch):
    from tiercat.operators import predict as pr
    cats = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "category string, category_id int")
    subs = spark.createDataFrame([(f"s{i}", i) for i in range(5)], "sub_category string, subcategory_id int")
    cmap = spark.createDataFrame([(0, [0, 1]), (1, [2]), (2, [3, 4])], "category_id int, sub_ids array<int>")
    d = spark.createDataFrame([(1, [.2, .5, .3], [.1, .2, .3, .2, .2]), (2, [.4, .4, .2], [0.0, 0.0, 1.0, 0.0, 0.0])],
                              "id long, cat_prob array<double>, sub_prob array<double>")
    there = pr.classify(d, cmap, cats, subs, k=3)
    monkeypatch.setattr(pr.name_list, "__defaults__", (0,))
    joined = pr.classify(d, cmap, cats, subs, k=3)
    cols = ["id", "category", "subcategory", "top_categories", "top_subcategories"]
    assert sorted(there.select(cols).collect()) == sorted(joined.select(cols).collect())
    text = there._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") == 1 < joined._jdf.queryExecution().optimizedPlan().toString().count("Join")
    # ids with gaps are looked up by joins
    assert pr.name_list(subs.where("subcategory_id <> 2"), 1 << 20) is None
