"""S1/S2 sources: pandas-style null tokens, doubled quotes, embedded newlines, row caps."""

from tiercat.sources.io import cap_rows, read_csv


def test_csv_edge_cases(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text(
        'clean_description,type,category,sub_category\n'
        '"A ""quoted"" shop",debit,Shops,Food\n'
        'NA,credit,Shops,Food\n'
        'null,,Transfer,Wire\n'
        'None,None,Transfer,Wire\n'
        '"two\nlines",debit,Service,Phone\n'
        ',debit,Service,Phone\n', encoding="utf-8")
    rows = read_csv(spark, str(p), multi_line=True).collect()
    assert len(rows) == 6
    assert rows[0]["clean_description"] == 'A "quoted" shop'
    assert rows[1]["clean_description"] is None
    assert rows[2]["clean_description"] is None and rows[2]["type"] is None
    assert rows[3]["clean_description"] is None and rows[3]["type"] is None
    assert rows[4]["clean_description"] == "two\nlines"
    assert rows[5]["clean_description"] is None


def test_row_cap(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert cap_rows(df, None).count() == 100
    got = [r.k for r in cap_rows(df, 7, order_by="k").collect()]
    assert got == list(range(7))


def test_splits_round_trip(spark, tmp_path):
    from tiercat.sources.io import read_split, write_splits
    df = spark.createDataFrame([(1, "a", "train"), (2, None, "val"), (3, "c", "train")], "k long, t string, split string")
    path = str(tmp_path / "splits")
    write_splits(df, path)
    assert sorted(tuple(r) for r in read_split(spark, path, "train").select("k", "t").collect()) == [(1, "a"), (3, "c")]
    assert [tuple(r) for r in read_split(spark, path, "val").select("k", "t").collect()] == [(2, None)]


def test_head_of_files_in_their_order(spark, tmp_path):
    """The first rows of several files, in path order, whatever the splits."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    import pytest
    from tiercat.sources.io import cap_rows
    for k, name in enumerate(("b", "a", "c")):
        t = pa.table({"id": list(range(k * 1000, k * 1000 + 700)), "_head_file": ["x"] * 700})
        pq.write_table(t.drop_columns("_head_file"), tmp_path / f"{name}.parquet", row_group_size=50)
        (tmp_path / f"{name}.csv").write_text("id\n" + "\n".join(map(str, t["id"].to_pylist())))
    order = [*range(1000, 1700), *range(700), *range(2000, 2700)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        for kind in ("parquet", "csv"):
            d = spark.read.option("header", True).format(kind).load(str(tmp_path / f"*.{kind}"))
            for n in (1, 699, 700, 701, 1500, 2100, 5000):
                if kind == "csv" and n < 5000:
                    n = min(n, 100)  # a file of several blocks
                got = [int(r.id) for r in cap_rows(d, n).collect()]
                assert sorted(got) == sorted(order[:n]), (kind, n)
        assert cap_rows(d, 0).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(ValueError):
        cap_rows(spark.range(10), 3)
