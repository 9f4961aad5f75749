"""Quality classifier: text statistics scored by an additive model of lookup tables.

The statistics of every whole text are computed once, next to the text, and stored; the
classifier is fitted on a bounded sample of the labelled rows (``max_train_rows``, the rows
with the smallest key hashes) and scores the stored statistics by adding table entries.

Defined cases: a null text is empty; an empty text is scored like any other; labelled rows
with a null label or key are not learned from; without labels every score is 0.5; documents
that repeat are scored each; labels that repeat a key are learned each.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tiercat.llm import gam
from tiercat.llm.common import col, fold, parts, stored, texts_of

FEATURES = ("log_words", "word_len", "long_word", "distinct", "twin", "upper", "title", "digit",
            "space", "mark", "odd_mark", "shout", "wide", "end", "comma", "line_words",
            "line_repeat", "top_word", "pair_distinct", "junk_words")

_KIND = np.zeros((256, 10))
for _c in range(256):
    _ch = chr(_c) if _c < 128 else ""
    _KIND[_c] = (
        "A" <= _ch <= "Z", "a" <= _ch <= "z", _ch.isdigit(), _ch in " \t\r\n\v\f" and _ch != "",
        bool(_ch) and not _ch.isalnum() and not _ch.isspace(),
        _ch in "#$%&*+/<=>@[\\]^_`{|}~" and _ch != "", _ch == "!", _c >= 128, _ch == ".", _ch == ",")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"?()-")


def features(raw: bytes) -> list[float]:
    """Statistics of one text; all 0 for an empty one."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KIND
    upper, lower, digit, space, mark, odd, shout, wide, end, comma = kinds / len(raw)
    lens = list(map(len, words))
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), sum(lens) / n, max(lens) / 10.0, len(tally) / n ** 0.75,
        sum(map(eq, words, words[1:])) / n, upper / (upper + lower + 1e-9),
        sum(w[:1].isupper() for w in words) / n, digit, space, mark, odd, shout, wide, end, comma,
        n / len(lines), 1.0 - len(set(lines)) / len(lines), max(tally.values()) / n,
        len(set(zip(words, words[1:]))) / n, sum(w[-1] in _MARKS for w in words) / n]


def measure(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, held_out, x array<float>) of every document, by one pass over the texts."""
    d = docs.select(col(key).alias("key"), fold(key).alias("fold"), col(text).cast("string").alias("text"))
    schema = f"key {d.schema['key'].dataType.simpleString()}, fold long, x array<float>"

    def run(batches):
        for b in parts(batches):
            x = [features(t) for t in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(x, pa.list_(pa.float32()))], ["key", "fold", "x"])

    return d.mapInArrow(run, schema)


def train(measured: DataFrame, labels: DataFrame, key: str, label: str,
          max_train_rows: int = 20_000, held_fold: int = 0) -> gam.Gam:
    """Fit on at most ``max_train_rows`` labelled rows outside the held-out fold."""
    lab = labels.select(col(key).alias("key"), col(label).cast("double").alias("y")) \
        .where("key IS NOT NULL AND y IS NOT NULL")
    rows = (measured.where(F.col("fold") != held_fold).join(lab, "key")
            .select("x", "y", F.xxhash64("key").alias("h")).orderBy("h", "x", "y").limit(max_train_rows)
            .toPandas())
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return gam.fit(x, rows["y"].to_numpy(dtype=np.float64))


def score(measured: DataFrame, model: gam.Gam) -> DataFrame:
    """(key, fold, score) by vectorised table look-ups."""
    def run(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False)
            p = model.probability(x.reshape(b.num_rows, len(FEATURES)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p)],
                                             ["key", "fold", "score"])

    kind = measured.schema["key"].dataType.simpleString()
    return measured.mapInArrow(run, f"key {kind}, fold long, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             label: str = "quality", threshold: float = 0.3, max_train_rows: int = 20_000) -> DataFrame:
    """One row per document: key, held_out, score, predicted (1 if score >= threshold)."""
    measured = stored(measure(docs, key, text), "quality-features")
    model = train(measured, labels, key, label, max_train_rows)
    return score(measured, model).select(
        "key", (F.col("fold") == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
              label: str = "quality", threshold: float = 0.3, max_train_rows: int = 20_000) -> DataFrame:
    """The documents that the classifier does not reject, all columns. Only the rows it is fitted on are
    measured beforehand; the fitted tables are applied next to the text, so no join brings scores and texts
    together."""
    # the keys that train() takes, at most as many as its rows; with them come all rows that share a key
    lab = labels.select(col(key).alias("key")).where(col(key).isNotNull() & col(label).isNotNull())
    keys = docs.select(col(key).alias("key")).where(fold(key) != 0).join(lab, "key") \
        .select("key", F.xxhash64("key").alias("h")).orderBy("h").limit(max_train_rows).select("key").distinct()
    keys = F.broadcast(stored(keys, "quality-keys"))
    some = docs.select(col(key).alias("key"), col(text).alias("text")).join(keys, "key", "left_semi")
    measured = stored(measure(some, "key", "text"), "quality-features")
    model = train(measured, labels, key, label, max_train_rows)

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        x = np.empty((len(texts), len(FEATURES)), np.float32)
        for i, t in enumerate(texts):
            x[i] = features((t or "").encode())
        return pd.Series(model.probability(x.astype(np.float64)))

    return docs.where(quality(col(text).cast("string")) >= threshold)

