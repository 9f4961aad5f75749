"""Language-model scores of whole texts: a gated recurrent model over the frequent words, with
rare words told apart by their corpus counts.

1. Words (and one end per text, the empty word) of all training texts are counted.
2. The ``head``, at most ``head_words`` of the most frequent words (a fixed bound; words up to
   64 bytes), travels to the tasks. Its first ``model_words`` are words of the model; every
   other word belongs to a rare class by its last two bytes. Texts are turned into model ids
   once, and stored; a text keeps its words outside the head in a list.
3. Counts of those meet the lists by a join on the word, whatever their number.
4. Training goes over all training texts in rounds of growing size: in each, every partition trains
   on its texts from the common parameters, and the results are averaged by tokens seen.
5. Scoring carries the state through each whole text.

p(word) = p(class | state) p(word | class, state) for model words, and for a rare word
p(class | state) (c + 0.5) / (sum over the class of (c + 0.5) + 0.5), where the last 0.5 is for
words never seen. So probabilities sum to 1 over the known words and one unknown per class.

Defined cases: a null text is empty and has one token, its end; repeated rows are scored, and
learned from, each; a null key is held out by the hash of the empty text; without training
texts all counts are 0 and the model is uniform over its classes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tiercat.llm import gru
from tiercat.llm.common import col, fold, lower_words, parts, stored, texts_of

END = b""
ROUNDS = (1, 3, 7, 15, 32)  # of 32 shares of the training texts, those learned by the end of each
CHUNKS = 32
SLICE = 1 << 22  # ids
LOT = 512  # partitions whose parameters are averaged together
LONGEST = 64
_LN10 = float(np.log(10.0))


def rare_class(word: bytes, rare: int) -> int:
    return zlib.crc32(word[-2:]) % rare


def word_counts(texts: DataFrame, held_fold: int, rare: int, held: int = 200_000) -> DataFrame:
    """(word, kind, n) over the training texts (text, fold): tasks add up what they meet, and hand on
    their sums before they hold more than ``held`` words."""
    def run(batches):
        tally: Counter[bytes] = Counter()

        def told():
            words = list(tally)
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([rare_class(w, rare) for w in words], pa.int32()),
                 pa.array(list(tally.values()), pa.int64())], ["word", "kind", "n"])
            tally.clear()
            return out

        for b in parts(batches):
            for t in texts_of(b.column(0)):
                tally.update(lower_words(t))
            tally[END] += b.num_rows
            if len(tally) > held:
                yield told()
        if tally:
            yield told()

    d = texts.where(F.col("fold") != held_fold).select("text")
    return d.mapInArrow(run, "word binary, kind int, n long").groupBy("word", "kind").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The head and the sums that probabilities need."""

    def __init__(self, counts: DataFrame, head_words: int, model_words: int, rare: int):
        total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
        self.tokens, self.types = int(total[0] or 0), int(total[1])
        # the least count of the head, by a histogram of a bounded number of steps
        step = F.floor(F.log2("n") * 64).cast("int")
        sizes = {r[0]: r[1] for r in counts.where(F.length("word") <= LONGEST).groupBy(step.alias("s"))
                 .agg(F.count(F.lit(1))).collect()}
        least, held = None, 0
        for s in sorted(sizes, reverse=True):
            if held + sizes[s] > head_words:
                break
            least, held = s, held + sizes[s]
        top = counts.where(F.length("word") <= LONGEST)
        top = top.where(step >= least) if least is not None else top.where("false")
        rows = top.select("word", "n").toArrow()
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.words = [words[i] for i in order]
        self.counts = n[order] if len(order) else np.zeros(0, np.int64)
        self.model_words, self.rare = min(model_words, len(self.words)), rare
        # words and sums of each rare class: all words of the class less its model words
        kinds = np.zeros((rare, 2))
        for kind, size, known in counts.groupBy("kind").agg(F.sum("n"), F.count(F.lit(1))).collect():
            kinds[kind] = size, known
        for w, c in zip(self.words[:self.model_words], self.counts):
            kinds[rare_class(w, rare)] -= float(c), 1
        self.rare_counts = kinds[:, 0]
        self.rare_mass = kinds[:, 0] + 0.5 * kinds[:, 1] + 0.5

    def layout(self, hidden: int, classes: int) -> gru.Layout:
        return gru.Layout(gru.classes_of(self.counts[:self.model_words], classes), self.rare, hidden)

    def frequencies(self) -> np.ndarray:
        return np.concatenate([self.counts[:self.model_words], self.rare_counts]).astype(np.float64)


def encoded(texts: DataFrame, vocabulary: Vocabulary, held_fold: int) -> DataFrame:
    """(row, key, fold, share, n_tokens, n_known, logs, rare_logs, ids, tail) of ``texts``: logs is the
    sum of log10(c + 0.5) over the head's words, rare_logs that part of the score that rare words
    have beside their class; tail lists the words outside the head with their numbers."""
    spark = texts.sparkSession
    v = vocabulary
    logs = np.log10(v.counts + 0.5)
    classes = np.array([rare_class(w, v.rare) for w in v.words], np.int64)
    ids = np.where(np.arange(len(v.words)) < v.model_words, np.arange(len(v.words)), v.model_words + classes)
    beside = np.where(np.arange(len(v.words)) < v.model_words, 0.0, logs - np.log10(v.rare_mass)[classes])
    held = spark.sparkContext.broadcast((v.words, ids.astype(np.uint16), logs, beside))
    rare, first, mass = v.rare, v.model_words, np.log10(v.rare_mass)

    def run(batches):
        words, ids_, logs_, beside_ = held.value
        place = {w: i for i, w in enumerate(words)}
        get, crc = place.get, zlib.crc32
        for b in parts(batches):
            rows, tail_words, tail_n, ends = [], [], [], [0]
            for t in texts_of(b.column(3)):
                said = lower_words(t)
                said.append(END)
                a = np.fromiter(map(get, said, repeat(-1)), np.int64, len(said))
                known = a >= 0
                out, extra = np.empty(len(a), np.uint16), 0.0
                if not known.all():
                    at = np.flatnonzero(~known)
                    missed = [said[i] for i in at.tolist()]
                    kinds = [crc(w[-2:]) % rare for w in missed]
                    out[at] = np.array(kinds, np.uint16) + first
                    extra = -float(mass[kinds].sum())
                    tail = Counter(missed)
                    tail_words += tail
                    tail_n += tail.values()
                ends.append(len(tail_words))
                inside = a[known]
                out[known] = ids_[inside]
                rows.append((len(a), len(inside), float(logs_[inside].sum()),
                             float(beside_[inside].sum()) + extra, out.tobytes()))
            tails = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(tail_words, pa.binary()), pa.array(tail_n, pa.int64())], ["word", "n"]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2)] + [pa.array(x, kind) for x, kind in zip(
                    zip(*rows) if rows else [()] * 5,
                    (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))] + [tails],
                ["key", "fold", "share", "n_tokens", "n_known", "logs", "rare_logs", "ids", "tail"])

    kind = texts.schema["key"].dataType.simpleString()
    d = texts.select("key", "fold", "share", "text").mapInArrow(
        run, f"key {kind}, fold long, share int, n_tokens long, n_known long, logs double, rare_logs double, "
             "ids binary, tail array<struct<word:binary,n:bigint>>")
    return d.withColumn("row", F.monotonically_increasing_id())


def trained(rows: DataFrame, layout: gru.Layout, start: np.ndarray, held_fold: int, rate: float) -> np.ndarray:
    """Parameters after all rounds over the training rows (fold, share, ids) of ``rows``."""
    spark = rows.sparkSession
    vector, done = start, 0
    for until in ROUNDS:
        now = spark.sparkContext.broadcast(vector)
        d = rows.where((F.col("fold") != held_fold) & F.col("share").between(done, until - 1)).select("ids")

        def run(batches, now=now):
            trainer = gru.Trainer(layout, layout.unflat(now.value), rate)
            # a partition is trained on in slices, so a task holds a slice's ids whatever its rows
            tokens, held, size = 0, [], 0
            for b in batches:
                for x in b.column(0).to_pylist():
                    held.append(np.frombuffer(x, np.uint16))
                    size += len(held[-1])
                    if size >= SLICE:
                        tokens += trainer.train(held)
                        held, size = [], 0
            tokens += trainer.train(held)
            if tokens:
                cut = np.array_split(layout.flat(trainer.p), CHUNKS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(CHUNKS), pa.int32()), pa.array([tokens] * CHUNKS, pa.float64()),
                     pa.array([c.astype(np.float32).tobytes() for c in cut], pa.binary())],
                    ["chunk", "weight", "part"])

        def mean(group: pd.DataFrame) -> pd.DataFrame:
            w = group["weight"].to_numpy()
            total = np.zeros(len(group["part"].iloc[0]) // 4)
            for weight, part in zip(w, group["part"]):
                total += weight * np.frombuffer(part, np.float32)
            return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "weight": [w.sum()],
                                 "part": [(total / w.sum()).astype(np.float32).tobytes()]})

        # partitions are averaged in lots, then the lots: no group grows with the corpus alone
        kind = "chunk int, weight double, part binary"
        lots = d.mapInArrow(run, kind).withColumn("lot", F.floor(F.spark_partition_id() / LOT))
        averaged = lots.groupBy("chunk", "lot").applyInPandas(mean, kind) \
            .groupBy("chunk").applyInPandas(mean, kind).collect()
        if averaged:
            vector = np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(averaged, key=lambda r: r["chunk"])])
        now.unpersist()
        done = until
    return vector


def model_scores(rows: DataFrame, layout: gru.Layout, vector: np.ndarray) -> DataFrame:
    """``rows`` without ids and tail, and with ``model``: the model's log10 probability of its ids."""
    held = rows.sparkSession.sparkContext.broadcast(vector)
    names = ["row", "key", "fold", "n_tokens", "n_known", "logs", "rare_logs"]
    d = rows.select(*names, "ids")

    def run(batches):
        p = layout.unflat(held.value)
        for b in batches:
            docs = [np.frombuffer(x, np.uint16).astype(np.int64) for x in b.column(len(names)).to_pylist()]
            lp = gru.score(layout, p, docs) / _LN10
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(lp)], [*names, "model"])

    schema = ", ".join(f"{n} {d.schema[n].dataType.simpleString()}" for n in names)
    return d.mapInArrow(run, f"{schema}, model double")


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", held_fold: int = 1,
           head_words: int = 1 << 19, model_words: int = 2048, rare: int = 32, classes: int = 32,
           hidden: int = 12, rate: float = 0.1) -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = docs.select(
        col(key).alias("key"), fold(key).alias("fold"), col(text).cast("string").alias("text"),
        F.pmod(F.xxhash64(F.coalesce(col(key).cast("string"), F.lit(""))), F.lit(32)).cast("int").alias("share"))
    counts = stored(word_counts(texts, held_fold, rare), "word-counts")
    v = Vocabulary(counts, head_words, model_words, rare)
    rows = stored(encoded(texts, v, held_fold), "word-ids")
    layout = v.layout(hidden, classes)
    start = layout.flat(layout.initial(v.frequencies()))
    vector = trained(rows, layout, start, held_fold, rate)
    scored = model_scores(rows, layout, vector)

    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", F.col("t.n").alias("m"))
    c = F.coalesce(F.col("n"), F.lit(0))
    tail = tail.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.col("m") * F.log10(c + 0.5)).alias("tail_logs"),
        F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("tail_known"))
    out = scored.join(tail, "row", "left")
    tail_logs = F.coalesce("tail_logs", F.lit(0.0))
    norm = float(np.log10(v.tokens + 0.5 * (v.types + 1)))
    return out.select(
        "key", (F.col("fold") == held_fold).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + tail_logs - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("model") + F.col("rare_logs") + tail_logs).alias("score"))
