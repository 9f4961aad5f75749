"""Cleaning, rare filter, label ids and the category map against plain Python."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tiercat.operators import prepare as prep
from tiercat.plans import fixtures as fx

from folders import SF_SMALL


def test_strip_matches_python(spark):
    texts = ["\t a  ", " x　", " \n", "plain", "\x1cy\x1f", "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)],
                               "doc_id long, clean_description string")
    got = {r.doc_id: r.clean_description for r in prep.strip_text(df).collect()}
    assert got == {i: t.strip() for i, t in enumerate(texts)}


def test_clean_and_rare_filter(spark):
    raw = fx.txn_nulls(spark, SF_SMALL)
    rows = raw.collect()
    kept = [r for r in rows if r.clean_description is not None and r.category is not None
            and r.sub_category is not None and r.clean_description.strip() != ""]
    assert prep.clean(raw).count() == len(kept)
    counts = Counter(r.sub_category for r in kept)
    want = sorted(r.doc_id for r in kept if counts[r.sub_category] >= 2)
    got = sorted(r.doc_id for r in prep.filter_rare(prep.clean(raw), "sub_category", 2)
                 .select("doc_id").collect())
    assert got == want


def test_label_ids_and_map_many_to_many(spark):
    p = fx.prepare(fx.txn_m2m(spark, SF_SMALL), 2)
    rows = p.rows.collect()
    cats = sorted({r.category for r in rows})
    subs = sorted({r.sub_category for r in rows})
    assert all(r.category_id == cats.index(r.category) for r in rows)
    assert all(r.subcategory_id == subs.index(r.sub_category) for r in rows)
    want = defaultdict(set)
    for r in rows:
        want[r.category_id].add(r.subcategory_id)
    got = {r.category_id: list(r.sub_ids) for r in prep.category_map(p.rows).collect()}
    assert got == {k: sorted(v) for k, v in want.items()}
    # one subcategory sits under several categories
    owners = Counter(s for v in got.values() for s in v)
    assert max(owners.values()) > 1


def test_row_accounting(spark):
    raw = fx.txn_nulls(spark, SF_SMALL)
    r = prep.row_accounting(raw, min_count=2).first()
    assert r.initial_rows == raw.count()
    assert r.rows_after_cleaning == prep.clean(raw).count()
    assert r.rows_after_rare_filter == prep.filter_rare(prep.clean(raw), "sub_category", 2).count()
