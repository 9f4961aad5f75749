import pytest
from pyspark.sql import functions as F

CLASHING = ("key", "h", "v", "words", "line", "row", "fp", "body", "size", "target", "copies", "part", "at",
            "fold", "x", "score", "host", "paths", "id", "norm", "n", "doc_key", "a.b")

ROWS = [
    (1, "one two three four five six\nshort line\n\none two three four five six", "en", "b"),
    (2, "one two three four five seven\nalpha beta gamma delta epsilon", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, "   \n\t ", "de", "a"),
    (6, "alpha beta gamma delta\none two three four five six", None, "b"),
    (6, "alpha beta gamma delta\none two three four five six", None, "b"),
    (6, "another text of the same key stands here", "fr", None),
    (7, "é" * 300 + " " + "xyz " * 400, "fr", "c"),
    (8, "Alpha, BETA gamma\r\ndelta epsilon zeta eta theta", "fr", "c"),
    (9, "word", "fr", "c"),
    (None, "one two three four five six and a null key", "fr", "c"),
    (10, " ".join(f"w{i}" for i in range(20_000)), "en", "a"),
    (11, " ".join(f"w{i}" for i in range(20_000)), "en", "a"),
    (12, "be " * 5_000, "en", "a"),
]


def with_clashes(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""
    schema = "doc_id long, text string, lang string, source string"
    d = spark.createDataFrame(ROWS, schema).withColumn("n_chars", F.length("text").cast("long"))
    return with_clashes(d.repartition(3))


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.where("false")
