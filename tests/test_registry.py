"""Driver contract: entry() runs; every oracle belongs to a query."""

import importlib


def test_entry_and_registry(spark):
    m = importlib.import_module("__spark_entry__")
    df = m.entry(spark)
    assert df.count() == 4 and df.columns == ["category_id", "sub_ids", "n_sub"]
    qs, sq = m.queries(), m.oracle_sql()
    assert set(sq) <= set(qs)
    assert len(qs) >= 60
