"""Keyword mining against a brute-force Python version of rank -> lookup -> filter, and the
JSON sink."""

import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tiercat.operators import keywords as kw


def test_keywords_brute_force(spark, tmp_path):
    rnd = random.Random(11)
    terms = [f"t{i}" for i in range(60)]
    docs = [(d, d % 3) for d in range(90)]
    pres = sorted({(d, c, rnd.choice(terms[:40])) for d, c in docs for _ in range(6)})
    weights = [(c, t, round(rnd.uniform(-1, 1), 2)) for c in range(3) for t in terms]
    P = spark.createDataFrame(pres, "doc_id long, cls int, term string")
    D = spark.createDataFrame(docs, "doc_id long, cls int")
    W = spark.createDataFrame(weights, "class_id int, term string, weight double")
    got = {(r.class_id, r.direction, r.rank, r.term): (r.support_class, r.dominance)
           for r in kw.keywords(W, P, D, "cls", top_n=8).collect()}

    sc, st, nc = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, c, t in pres:
        sc[(c, t)] += 1
        st[t] += 1
    for d, c in docs:
        nc[c] += 1
    want = {}
    for c in range(3):
        ws = [(t, w) for cc, t, w in weights if cc == c]
        for direction, order in (("include", sorted(ws, key=lambda x: (-x[1], x[0]))),
                                 ("exclude", sorted(ws, key=lambda x: (x[1], x[0])))):
            for rank, (t, w) in enumerate(order[:8], 1):
                if st[t] == 0:
                    continue  # no statistics for the term: dropped
                s = sc[(c, t)]
                dom = s / st[t]
                if (s >= 3 and dom >= 0.05) or dom >= 0.5:
                    want[(c, direction, rank, t)] = (s, dom)
    assert got.keys() == want.keys()
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 and got[k][0] == want[k][0] for k in want)

    names = spark.createDataFrame([(f"class{c}", c) for c in range(3)], "name string, id int")
    res = kw.keywords(W, P, D, "cls", top_n=8)
    docs_json = kw.keyword_documents(res, names, "category").collect()
    assert len(docs_json) == 3
    one = json.loads(docs_json[0].keywords)
    assert set(one) == {"include", "exclude"}
    # One JSON line per class, read back unchanged
    from tiercat.sources.io import write_json_lines
    out = str(tmp_path / "kw")
    write_json_lines(kw.keyword_documents(res, names, "category"), out)
    back = {r.class_name: json.loads(r.keywords) for r in spark.read.json(out).collect()}
    assert back == {r.class_name: json.loads(r.keywords) for r in docs_json}
