"""TF-IDF over word 1-2-grams in long form.

Vectorizer semantics (the reference's settings): lower-case, strip accents, tokens of
letters/digits/underscore, unigrams + bigrams, vocabulary = terms in at least ``min_df``
documents, capped to the ``max_features`` terms with the highest corpus count (ties by
term), sublinear tf 1 + ln(tf), smoothed idf ln((1 + N) / (1 + df)) + 1, L2 row norm.

Plan shape, chosen for scale:
  * documents become one row of words each (:func:`word_rows`); only texts whose key repeats are shuffled. The words are
    written once; :func:`fit_words` counts terms over slices of bounded text, :meth:`TfidfModel.sparse_of` looks terms
    up in the vocabulary. No row a (document, term) is made, and no pass holds more than a slice;
  * of a large corpus, :func:`fit_words` first adds up one row of hashed counters (:class:`Sketch`). Terms whose counter
    stays below a threshold are not counted: the threshold is the least document frequency, or a corpus count that more
    than enough terms reach for the cap, and it is lowered if their exact counts say that they do not. A counter is
    never below a term's corpus count, so no term of the vocabulary is lost;
  * rows are stored as (indices, tf, norm): a weight is (1 + ln tf) * idf / norm, so none is written;
  * in the long form (:func:`term_frequencies`) documents are hash-partitioned by key once (one shuffle of the raw
    text); exploding n-grams and counting tf per (doc, term) then run without another exchange;
  * document frequencies first go into a sketch of counters (as many as the terms, narrow, summed map-side);
    only terms whose counters reach ``min_df`` are shuffled as strings and counted exactly. A counter is
    never below a term's frequency, so no term is lost;
  * the term counts are written bucketed by document, so bringing a document's terms together in one row, its
    norm, presence and the feature table need no exchange by document;
  * the vocabulary is capped by an exact, distributed cutoff (a histogram of corpus counts)
    instead of a global sort; it is a written table, so the planner sees its size when the
    tf rows join it.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tiercat.functions.text import normalize_text, sublinear_tf, tokens, word_ngrams
from tiercat.operators.blocks import added_up
from tiercat.session import materialize

# The reference's vectorizer defaults (minimum document frequency, cap).
MIN_DF = 10
MAX_FEATURES = 200_000

BROADCAST_BYTES = 64 << 20

# Text that one task counts the terms of: its distinct (document, term) pairs take some 60 times as much memory.
TEXT_BYTES = 8 << 20


def text_partitions(docs: DataFrame, text: str, part: int = TEXT_BYTES) -> int:
    """How many partitions by document keep the text of one below ``part`` bytes, about; the session's number at
    least. Their number grows with the texts, so the memory of one task does not."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part))


def term_frequencies(docs: DataFrame, key: str, text: str, carry=(),
                     n_min: int = 1, n_max: int = 2, partitions: int | None = None) -> DataFrame:
    """``(key, *carry, term, tf)``: one row per distinct term of each document.

    ``carry`` columns (labels, split) are per-document values that ride along."""
    by_doc = (docs.repartition(partitions, key) if partitions else docs.repartition(key))
    # tokens are one projected column; n-grams read that column (no re-tokenising)
    toks = by_doc.select(key, *carry, tokens(normalize_text(F.col(text))).alias("_toks"))
    grams = toks.select(key, *carry,
                        F.explode(word_ngrams(F.col("_toks"), n_min, n_max)).alias("term"))
    return grams.groupBy(key, *carry, "term").agg(F.count(F.lit(1)).alias("tf"))


# Between the words of texts that share a key; no word holds it.
BREAK = "\n"

# Bytes of words that a task counts at once (a longer text alone).
SLICE_BYTES = 8 << 20


def word_lists(docs: DataFrame, key: str, text: str, carry=(), partitions: int | None = None, copies=()) -> DataFrame:
    """``(key, *carry, words, *copies)``: a document's words joined by spaces. Texts that share key and ``carry`` are one
    document, with ``BREAK`` between them, which no n-gram crosses; ``copies`` are further aggregates of them."""
    w = docs.select(key, *carry, F.array_join(tokens(normalize_text(F.col(text))), " ").alias("words"))
    w = w.repartition(partitions, key) if partitions else w.repartition(key)
    return w.groupBy(key, *carry).agg(F.array_join(F.collect_list("words"), f" {BREAK} ").alias("words"), *copies)


def word_rows(docs: DataFrame, key: str, text: str, carry=(), partitions: int | None = None) -> DataFrame:
    """:func:`word_lists` with ``copies`` (how many texts a row holds) and ``again`` (whether other texts have its key).
    Only texts whose key repeats are shuffled; the others keep their places."""
    again = materialize(docs.sparkSession, docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col(key).alias("_key")), "repeated-keys")
    alone = lambda d: d.select(key, *carry, F.coalesce(
        F.array_join(tokens(normalize_text(F.col(text))), " "), F.lit("")).alias("words"),
        F.lit(1).cast("long").alias("copies"), F.lit(False).alias("again"))
    if again.isEmpty():
        return alone(docs)
    same = F.col(key).eqNullSafe(F.col("_key"))
    some = word_lists(docs.join(again, same, "left_semi"), key, text, carry, partitions, [F.count(F.lit(1)).alias("copies")])
    return alone(docs.join(again, same, "left_anti")).unionByName(some.withColumn("again", F.lit(True)))


def _slices(batch: pa.RecordBatch, column: int, most: int):
    """``batch`` in slices of at most ``most`` bytes of a string column, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def _coded(words: pa.Array):
    """(document, code) of every word, the distinct words by code, and whether a code is a word at all."""
    lists = pc.split_pattern(pc.fill_null(words, ""), " ")
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    encoded = lists.flatten().dictionary_encode()
    word, code = encoded.dictionary.cast(pa.string()), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = ~pc.is_in(word, value_set=pa.array(["", BREAK], word.type)).to_numpy(zero_copy_only=False)
    return doc, code, word, real


def gram_counts(words: pa.Array, n_min: int, n_max: int, passes=None):
    """(row, code, tf, terms) of the distinct n-grams of every row, by row: ``terms[code]`` is the n-gram. ``passes``
    tells from hashes (:func:`gram_hashes`) which n-grams count at all."""
    doc, code, word, real = _coded(words)
    text, now, whole = word, code, real[code]
    each = hashes = None if passes is None else word_hashes(word)[code]
    docs, codes, terms, seen = [], [], [], 0
    for n in range(1, n_max + 1):
        pair = now
        if n > 1:  # an n-gram is the shorter one before its last word, and that word
            m = max(len(code) - n + 1, 0)
            whole = whole[:m] & real[code[n - 1:]] & (doc[:m] == doc[n - 1:])
            pair = now[:m] * len(word) + code[n - 1:]
            hashes = None if passes is None else _longer(hashes[:m], each[n - 1:])
        at = np.flatnonzero(whole if passes is None else whole & passes(hashes))
        if n > 1:
            # a longer one needs them all
            pair, now = np.unique(pair if n < n_max else pair[at], return_inverse=True)
            text = pc.binary_join_element_wise(text.take(pa.array(pair // max(len(word), 1))),
                                               word.take(pa.array(pair % max(len(word), 1))), " ")
        if n >= n_min:
            docs.append(doc[at])
            codes.append((now if 1 < n == n_max else now[at]) + seen)
            terms.append(text)
            seen += len(text)
    cell, tf = np.unique(np.concatenate(docs) * max(seen, 1) + np.concatenate(codes), return_counts=True)
    return cell // max(seen, 1), cell % max(seen, 1), tf, pa.concat_arrays(terms)


# ---------------------------------------------------------------- hashed counters

_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(h * np.uint64(_STEP) + word)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of every string, by its bytes: a polynomial of them, mixed."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.zeros(len(words), np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[first:last].astype(np.uint64)
    up, down = (np.multiply.accumulate(np.full(last - first + 1, x, np.uint64)) for x in (_STEP, _BACK))
    sums = np.append(np.uint64(0), np.cumsum((data + np.uint64(1)) * up[:-1], dtype=np.uint64))
    a, b = offsets[:-1] - first, offsets[1:] - first
    return _mixed((sums[b] - sums[a]) * down[a])


def gram_hashes(words: pa.Array, n_min: int, n_max: int):
    """Hashes of all n-grams, repeated ones too, an array for each n."""
    doc, code, word, real = _coded(words)
    whole, each = real[code], word_hashes(word)[code]
    hashes = each
    for n in range(1, n_max + 1):
        if n > 1:
            m = max(len(code) - n + 1, 0)
            whole = whole[:m] & real[code[n - 1:]] & (doc[:m] == doc[n - 1:])
            hashes = _longer(hashes[:m], each[n - 1:])
        if n >= n_min:
            yield hashes[whole]


class Sketch:
    """Counters of hashed n-grams (2 ** ``bits``, a counter no less than the corpus count of any n-gram in it, up to
    ``MOST``), written in blocks. Tasks hand on their counters, so there is one a core."""
    MOST, BLOCK = 1 << 23, 1 << 18

    def __init__(self, words: DataFrame, n_min: int, n_max: int, bits: int):
        spark, most, block = words.sparkSession, self.MOST, self.BLOCK
        self.bits = bits

        def run(batches):
            cells, added = np.zeros(1 << bits, np.int32), 0
            for b in batches:
                for part in _slices(b, 0, SLICE_BYTES):
                    for h in gram_hashes(part.column(0), n_min, n_max):
                        np.add.at(cells, (h >> np.uint64(64 - bits)).astype(np.int64), np.int32(1))
                        added += len(h)
                if added > 1 << 30:  # exact in single precision, and no counter overflows
                    np.minimum(cells, most, out=cells)
                    added = 0
            for k in range(0, len(cells), block):
                part = np.minimum(cells[k:k + block], most).astype(np.float32)
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k // block], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                                     ["block", "sums"])

        counted = words.select("words").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, "block int, sums binary")
        self.cells = materialize(spark, added_up(
            counted, lambda k, v: [(k, np.minimum(v, most).astype(np.float32).tobytes())], "block int, sums binary", single=True),
            "gram-counters")
        self.grid = np.unique(np.floor(2 ** (np.arange(23 * 8 + 1) / 8)).astype(np.int64))  # thresholds
        grid = self.grid

        def reached(batches):
            n = np.zeros(len(grid), np.int64)
            for b in batches:
                for raw in b.column(1).to_pylist():
                    at = np.searchsorted(grid, np.frombuffer(raw, np.float32), side="right")
                    n += np.bincount(at, minlength=len(grid) + 1)[1:]
            yield pa.RecordBatch.from_arrays([pa.array([n[::-1].cumsum()[::-1].tolist()], pa.list_(pa.int64()))], ["n"])

        self.reached = np.sum([r.n for r in self.cells.mapInArrow(reached, "n array<long>").collect()]
                              or [np.zeros(len(grid))], axis=0)  # counters of a threshold at least

    def threshold(self, counters: int) -> int:
        """The greatest threshold that so many counters reach; 1 if none."""
        enough = np.flatnonzero(self.reached >= counters)
        return int(self.grid[enough[-1]]) if len(enough) else 1

    def passing(self, least: int) -> np.ndarray:
        """A bit a counter, whether it reaches ``least``."""
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(
                    [np.packbits(np.frombuffer(x, np.float32) >= least).tobytes() for x in b.column(1).to_pylist()], pa.binary())],
                    ["block", "bits"])

        out = np.zeros((1 << self.bits) // 8, np.uint8)
        for r in self.cells.mapInArrow(run, "block int, bits binary").collect():
            at = r["block"] * self.BLOCK // 8
            got = np.frombuffer(r["bits"], np.uint8)
            out[at:at + len(got)] = got
        return out


def _passes(bits: np.ndarray):
    shift = np.uint64(64 - (len(bits).bit_length() + 2))

    def passes(hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> shift).astype(np.int64)
        return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0

    return passes


def maybe_frequent(tf: DataFrame, min_df: int, most_bits: int = 24) -> Column:
    """Whether a row's term may stand in ``min_df`` documents: count-min over two hashed rows of counters, their
    number by the distinct terms (estimated), at most 2 ** ``most_bits``. What the rows are compared with is one
    bit a counter, a single row of 2 x 2 MB at most. With very many terms the counters fill up and more rare
    terms pass; none that is frequent fails."""
    spark = tf.sparkSession
    terms = tf.agg(F.approx_count_distinct("term")).first()[0]
    bits = min(max(12, (4 * terms).bit_length()), most_bits)
    cell = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col("term")), F.lit(1 << bits))
    words = (tf.select(F.posexplode(F.array(cell(0), cell(1))).alias("k", "cell"))
             .groupBy("k", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_df)
             .groupBy("k", F.shiftright("cell", 6).alias("at"))
             .agg(F.expr("bit_or(shiftleft(1L, CAST(cell % 64 AS INT)))").alias("word")))
    every = spark.range((1 << bits) // 64).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.col("id").alias("at"))
    filled = every.join(words, ["k", "at"], "left").groupBy("k").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("word", F.lit(0).cast("long")).alias("word")))),
        lambda x: x["word"]).alias("words"))
    filled = materialize(spark, filled, "frequent-cells")
    passes = lambda k: F.getbit(F.get(filled.where(F.col("k") == k).select("words").scalar(),
                                      F.shiftright(cell(k), 6).cast("int")), (cell(k) % 64).cast("int")) == 1
    return passes(0) & passes(1)


def document_frequencies(tf: DataFrame) -> DataFrame:
    """``(term, df, total)``: documents containing the term and its corpus count."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"),
                                  F.sum("tf").cast("long").alias("total"))


def cap_vocabulary(cand: DataFrame, max_features: int | None) -> DataFrame:
    """A11 cap: keep the ``max_features`` terms with the highest corpus count (ties by term).

    Exact without a global sort: a histogram of corpus counts (one row per distinct count)
    gives the cutoff count c; terms above c are all kept, and only the tie group at c is
    ordered (by term) to fill the remaining slots."""
    if max_features is None:
        return cand
    n = cand.count()  # a written table
    if n <= max_features:
        return cand
    hist = cand.groupBy("total").agg(F.count(F.lit(1)).alias("k"))
    w = Window.orderBy(F.col("total").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("above", F.coalesce(F.sum("k").over(w), F.lit(0)))
    cut = (hist.where((F.col("above") < max_features) &
                      (F.col("above") + F.col("k") >= max_features))
           .select("total", "above").first())
    c, above = int(cut["total"]), int(cut["above"])
    head = cand.where(F.col("total") > c)
    tie = cand.where(F.col("total") == c).orderBy("term").limit(max_features - above)
    return head.unionByName(tie)


class Lookup:
    """The vocabulary as words and chains of them: an n-gram is (the chain of its first n - 1 words, its last word)."""

    def __init__(self, terms: pa.Array, n_min: int, n_max: int):
        lists = pc.split_pattern(terms, " ")
        length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        encoded = lists.flatten().dictionary_encode()
        code, first = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, length.cumsum())[:-1]
        self.words, self.n_min, self.n_max, self.size = encoded.dictionary.cast(pa.string()), n_min, n_max, len(terms)
        self.chains, self.terms = [], []  # of n words: sorted (chain, word) and the term index at each, -1 for none
        node = code[first]
        for n in range(1, n_max + 1):
            at = np.flatnonzero(length >= n)  # longer terms pass through here
            if n == 1:
                self.chains.append(np.arange(len(self.words)))
            else:
                keys, node[at] = np.unique(node[at] * len(self.words) + code[first[at] + n - 1], return_inverse=True)
                self.chains.append(keys)
            ends, index = np.flatnonzero(length == n), np.full(len(self.chains[-1]), -1)
            index[node[ends]] = ends
            self.terms.append(index)

    @staticmethod
    def of(vocab: DataFrame, n_min: int, n_max: int) -> "Lookup":
        t = vocab.select("term", "term_idx").toArrow().sort_by("term_idx")
        return Lookup(t["term"].combine_chunks().cast(pa.string()) if len(t) else pa.array([], pa.string()), n_min, n_max)

    def counts(self, words: pa.Array):
        """(row, term index, tf) of the vocabulary's terms of every row, in order."""
        doc, code, word, real = _coded(words)
        known = pc.fill_null(pc.index_in(word, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        each = np.where(real, known, -1)[code]
        node, found = each, []
        for n in range(1, self.n_max + 1):
            if n > 1:
                m, keys = max(len(code) - n + 1, 0), self.chains[n - 1]
                at = np.flatnonzero((node[:m] >= 0) & (each[n - 1:] >= 0) & (doc[:m] == doc[n - 1:]))
                key = node[at] * len(self.words) + each[at + n - 1]
                pos = np.searchsorted(keys, key)
                hit = np.flatnonzero(keys[np.minimum(pos, len(keys) - 1)] == key) if len(keys) else np.zeros(0, np.int64)
                node = np.full(m, -1)
                node[at[hit]] = pos[hit]
            at = np.flatnonzero(node >= 0)
            index = self.terms[n - 1][node[at]]
            if n >= self.n_min:
                found.append(doc[at[index >= 0]] * max(self.size, 1) + index[index >= 0])
        cell, tf = np.unique(np.concatenate(found), return_counts=True)
        return cell // max(self.size, 1), cell % max(self.size, 1), tf


def weighed(batch: pa.RecordBatch, first: int, idf: np.ndarray):
    """((ends, indices), tf, weights) of a batch's rows of :meth:`TfidfModel.sparse_of`, whose columns begin at ``first``."""
    at, counts = batch.column(first), batch.column(first + 1)
    ends = at.offsets.to_numpy()
    terms = at.values.to_numpy()[ends[0]:ends[-1]] if len(at) else np.zeros(0, np.int32)
    begin = counts.offsets.to_numpy()
    tf = counts.values.to_numpy()[begin[0]:begin[-1]] if len(at) else np.zeros(0, np.int32)
    w = (1.0 + np.log(tf)) * idf[terms]
    w /= np.repeat(batch.column(first + 2).to_numpy(), np.diff(ends))
    return (ends - ends[0] if len(ends) else np.zeros(1, np.int32), terms), tf, w


def load_model(spark: SparkSession, path: str) -> "TfidfModel":
    """A vectorizer written by :meth:`TfidfModel.save`."""
    meta = json.loads(spark.read.text(os.path.join(path, "settings")).first()[0])
    return TfidfModel(spark.read.parquet(os.path.join(path, "vocabulary")), **meta)


@dataclass
class TfidfModel:
    """A fitted vectorizer: ``vocab`` is ``(term, term_idx, df, total, idf)``."""
    vocab: DataFrame
    n_docs: int
    size: int
    n_min: int = 1
    n_max: int = 2
    measured: int | None = None  # bytes of the terms, once asked for
    kept: np.ndarray | None = field(default=None, repr=False, compare=False)  # idf, once asked for

    def _beside(self, *columns: str) -> DataFrame:
        """Columns of the vocabulary for a join with documents' terms: broadcast if its measured bytes allow, so the
        documents keep their partitioning; else the planner shuffles both."""
        if self.measured is None:
            self.measured = self.vocab.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
        v = self.vocab.select(*columns)
        return F.broadcast(v) if self.measured <= BROADCAST_BYTES else v

    def _gathered(self, tf: DataFrame, key: str, carry) -> DataFrame:
        """One row per document that has a term of the vocabulary: ``(key, *carry, t, norm)``, t an array of (term_idx, tf,
        w) in order, not yet divided by the norm."""
        w = tf.join(self._beside("term", "term_idx", "idf"), "term", "inner").select(
            key, *carry, F.struct("term_idx", "tf", (sublinear_tf(F.col("tf")) * F.col("idf")).alias("w")).alias("t"))
        g = w.groupBy(key, *carry).agg(F.sort_array(F.collect_list("t")).alias("t"))
        norm = F.sqrt(F.aggregate("t", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
        return g.select(key, *carry, "t", norm.alias("norm"))

    def rows(self, tf: DataFrame, key: str, carry=()) -> DataFrame:
        """F7 + F8 (M8 on new documents): one row per document that has a term of the vocabulary, ``(key, *carry,
        terms)``, terms an array of (term_idx, tf, weight) in order; weight = (1 + ln tf) * idf, L2-normalised.
        If ``tf`` is bucketed by key, nothing is exchanged by key."""
        # a lambda that named the norm would evaluate it for every term
        return self._gathered(tf, key, carry).select(key, *carry, F.zip_with(
            "t", F.array_repeat("norm", F.size("t")), lambda x, n: F.struct(
                x["term_idx"].alias("term_idx"), x["tf"].alias("tf"), (x["w"] / n).alias("weight"))).alias("terms"))

    def _long(self, words: DataFrame, rest: list[str], kinds: list[str]) -> DataFrame:
        """The counts of documents' n-grams in long form."""
        n_min, n_max = self.n_min, self.n_max

        def long(batches):
            for b in batches:
                for part in _slices(b, len(rest), SLICE_BYTES):
                    row, code, tf, terms = gram_counts(part.column(len(rest)), n_min, n_max)
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(pa.array(row)) for c in part.columns[:-1]), terms.take(pa.array(code)),
                         pa.array(tf, pa.int64())], [*rest, "term", "tf"])

        return words.select(*rest, "words").mapInArrow(long, ", ".join([*kinds, "term string", "tf long"]))

    def idf(self) -> np.ndarray:
        """idf by term index."""
        if self.kept is None:
            t = self.vocab.select("term_idx", "idf").toArrow()
            self.kept = np.zeros(self.size)
            self.kept[t["term_idx"].to_numpy()] = t["idf"].to_numpy()
        return self.kept

    def sparse_of(self, words: DataFrame, key: str, carry=()) -> DataFrame:
        """A row for every row of ``words`` (:func:`word_rows`): ``(key, *carry, indices, tf, norm)``, its terms of the
        vocabulary in order, their counts, and the L2 norm of (1 + ln tf) * idf. The terms are looked up in the tasks, if
        the vocabulary's measured bytes allow that; else the counts in long form meet it in a join."""
        rest = [key, *carry]
        kinds = [f"`{c}` {words.schema[c].dataType.simpleString()}" for c in rest]
        self._beside("term")
        if self.measured > BROADCAST_BYTES:
            found = self._gathered(self._long(words, rest, kinds), key, carry).select(
                *[F.col(c).alias(f"_{c}") for c in rest], "t", "norm")
            t = F.coalesce("t", F.array().cast(found.schema["t"].dataType))
            return words.join(found, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in rest]), "left").select(
                *rest, t["term_idx"].alias("indices"), t["tf"].cast("array<int>").alias("tf"), F.coalesce("norm", F.lit(0.0)).alias("norm"))
        sent = words.sparkSession.sparkContext.broadcast((Lookup.of(self.vocab, self.n_min, self.n_max), self.idf()))

        def run(batches):
            lookup, idf = sent.value
            for b in batches:
                for part in _slices(b, len(rest), SLICE_BYTES):
                    row, idx, tf = lookup.counts(part.column(len(rest)))
                    ends = np.append(0, np.bincount(row, minlength=part.num_rows).cumsum())
                    w, norm, some = (1.0 + np.log(tf)) * idf[idx], np.zeros(part.num_rows), np.flatnonzero(np.diff(ends))
                    if len(some):
                        norm[some] = np.sqrt(np.add.reduceat(w * w, ends[some]))
                    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (idx, tf)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists, pa.array(norm)], [*rest, "indices", "tf", "norm"])

        return words.select(*rest, "words").mapInArrow(run, ", ".join(
            [*kinds, "indices array<int>", "tf array<int>", "norm double"]))

    def valued(self, rows: DataFrame) -> DataFrame:
        """Rows of :meth:`sparse_of` with ``values`` (the weights) in place of the norm."""
        rest = [c for c in rows.columns if c not in ("indices", "tf", "norm")]
        kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest]
        sent = rows.sparkSession.sparkContext.broadcast(self.idf())

        def run(batches):
            for b in batches:
                at, tf, values = weighed(b, 0, sent.value)
                lists = [pa.ListArray.from_arrays(pa.array(at[0], pa.int32()), pa.array(x, k))
                         for x, k in ((at[1], pa.int32()), (tf, pa.int32()), (values, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*b.columns[3:], *lists], [*rest, "indices", "tf", "values"])

        return rows.select("indices", "tf", "norm", *[F.col(f"`{c}`") for c in rest]).mapInArrow(
            run, ", ".join([*kinds, "indices array<int>", "tf array<int>", "values array<double>"]))

    def terms_of(self, sparse: DataFrame) -> DataFrame:
        """Rows of :meth:`sparse_of` as :meth:`rows` gives them."""
        rest = [c for c in sparse.columns if c not in ("indices", "tf", "norm")]
        return self.valued(sparse.where(F.size("indices") > 0)).select(*rest, F.arrays_zip(
            F.col("indices").alias("term_idx"), F.col("tf").cast("array<bigint>").alias("tf"), F.col("values").alias("weight")).alias("terms"))

    def rows_of(self, words: DataFrame, key: str, carry=()) -> DataFrame:
        """:meth:`rows` from the words of documents (:func:`word_lists`)."""
        return self.terms_of(self.sparse_of(words, key, carry))

    def weights(self, tf: DataFrame, key: str) -> DataFrame:
        """The weights of new documents in long form: ``(key, ..., term, term_idx, tf, weight)``."""
        return self.long(self.rows(tf, key, [c for c in tf.columns if c not in (key, "term", "tf")]))

    def long(self, rows: DataFrame) -> DataFrame:
        """The long form of :meth:`rows`: ``(..., term, term_idx, tf, weight)``."""
        rest = [c for c in rows.columns if c != "terms"]
        long = rows.select(*rest, F.explode("terms").alias("t")).select(*rest, "t.*")
        return long.join(self._beside("term", "term_idx"), "term_idx").select(
            *rest, "term", "term_idx", "tf", "weight")

    def save(self, path: str) -> None:
        """The vocabulary as parquet, the settings as one JSON line."""
        self.vocab.write.mode("overwrite").parquet(os.path.join(path, "vocabulary"))
        meta = {"n_docs": self.n_docs, "size": self.size, "n_min": self.n_min, "n_max": self.n_max}
        self.vocab.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
            .write.mode("overwrite").text(os.path.join(path, "settings"))

    def presence(self, tf: DataFrame, named: bool = True) -> DataFrame:
        """Distinct (document, term) pairs restricted to the vocabulary, of counts in long form or of
        :meth:`rows`; these have ``term_idx`` besides, or (``named`` false) in place of the term."""
        if "terms" not in tf.columns:
            return tf.join(self._beside("term"), "term", "left_semi")
        rest = [c for c in tf.columns if c != "terms"]
        items = F.arrays_zip(F.col("terms.term_idx").alias("term_idx"), F.col("terms.tf").alias("tf"))
        long = tf.select(*rest, F.inline(items)) if named else \
            tf.select(*rest, F.explode("terms.term_idx").alias("term_idx"))
        return self.named(long) if named else long

    def named(self, df: DataFrame) -> DataFrame:
        """``df`` with the ``term`` of its ``term_idx``."""
        return df.join(self._beside("term", "term_idx"), "term_idx")


def fit(tf: DataFrame, n_docs: int, min_df: int = MIN_DF,
        max_features: int | None = MAX_FEATURES, n_min: int = 1, n_max: int = 2) -> TfidfModel:
    """A11 + A12: vocabulary, term index (alphabetical, as the feature index) and idf.

    ``n_docs`` is the number of training documents, empty ones included."""
    some = tf.where(maybe_frequent(tf, min_df)) if min_df > 1 else tf
    return _fitted(document_frequencies(some), n_docs, min_df, max_features, n_min, n_max)


# Bytes of words from which on rare terms are told by a sketch before terms are counted.
SKETCH_BYTES = 64 << 20

# Rows of counts that a task holds before it adds them up by term, and hands them on if that does not halve them.
MERGE_ROWS = 1 << 20


def _merged(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by("term").aggregate([("df", "sum"), ("total", "sum")])
    return t.select(["term", "df_sum", "total_sum"]).rename_columns(["term", "df", "total"])


def _counted(words: DataFrame, n_min: int, n_max: int, partitions: int | None, bits: np.ndarray | None) -> DataFrame:
    """``(term, df, total)`` of the n-grams (that pass a sketch's ``bits``): counted slice by slice, added up in the
    task and then in ``partitions`` by term, exactly."""
    sent = None if bits is None else words.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        passes, held, n = None if sent is None else _passes(sent.value), [], 0
        for b in batches:
            for part in _slices(b, 0, SLICE_BYTES):
                _, code, tf, terms = gram_counts(part.column(0), n_min, n_max, passes)
                df = np.bincount(code, minlength=len(terms))
                at = np.flatnonzero(df)
                held.append(pa.table({"term": terms.take(pa.array(at)), "df": pa.array(df[at], pa.int64()),
                                      "total": pa.array(np.bincount(code, tf, len(terms))[at].astype(np.int64))}))
                n += len(at)
                if n > MERGE_ROWS:
                    held = [_merged(held)]
                    n = len(held[0])
                    if 2 * n > MERGE_ROWS:
                        yield from held[0].to_batches()
                        held, n = [], 0
        if held:
            yield from _merged(held).to_batches()

    counts = words.select("words").mapInArrow(run, "term string, df long, total long")
    counts = counts.repartition(partitions, "term") if partitions else counts
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def fit_words(words: DataFrame, n_docs: int, min_df: int = MIN_DF, max_features: int | None = MAX_FEATURES,
              n_min: int = 1, n_max: int = 2, partitions: int | None = None) -> TfidfModel:
    """:func:`fit` on the words of documents (:func:`word_rows`). Of many texts only the terms are counted whose sketched
    corpus count may suffice; if too few of them do, those of a lower threshold are."""
    size = words.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if size < SKETCH_BYTES or (min_df <= 1 and max_features is None):
        return _fitted(_counted(words, n_min, n_max, partitions, None), n_docs, min_df, max_features, n_min, n_max)
    sketch = Sketch(words, n_min, n_max, min(max(10, int(size // 4).bit_length()), 24))
    counters = 3 * max_features if max_features else None
    while True:
        least = max(min_df, sketch.threshold(counters)) if counters else min_df
        counts = _counted(words, n_min, n_max, partitions, sketch.passing(least) if least > 1 else None)
        dfs = materialize(words.sparkSession, counts.where(F.col("df") >= min_df), "document-frequencies")
        # every term of this corpus count has been counted
        if least <= max(min_df, 1) or dfs.where(F.col("total") >= least).count() >= max_features:
            return _of_frequencies(dfs, n_docs, max_features, n_min, n_max)
        counters *= 4


def _fitted(frequencies: DataFrame, n_docs: int, min_df: int, max_features: int | None, n_min: int, n_max: int) -> TfidfModel:
    dfs = materialize(frequencies.sparkSession, frequencies.where(F.col("df") >= min_df), "document-frequencies")
    return _of_frequencies(dfs, n_docs, max_features, n_min, n_max)


def _of_frequencies(dfs: DataFrame, n_docs: int, max_features: int | None, n_min: int, n_max: int) -> TfidfModel:
    spark = dfs.sparkSession
    vocab = materialize(spark, _numbered(cap_vocabulary(dfs, max_features)).withColumn(
        "idf", F.ln((F.lit(1.0) + n_docs) / (F.col("df") + 1.0)) + 1.0), "vocabulary")
    return TfidfModel(vocab, n_docs, int(vocab.count()), n_min, n_max)


def _numbered(vocab: DataFrame) -> DataFrame:
    """``term_idx``: the position in sorted term order, by ranges of terms; one row a range is summed up."""
    v = materialize(vocab.sparkSession, vocab.repartitionByRange("term").sortWithinPartitions("term")
                    .withColumn("_id", F.monotonically_increasing_id()), "terms")
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = v.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.shiftleft("_part", 33)).alias("_shift"))
    return v.withColumn("_part", part).join(shift, "_part").withColumn(
        "term_idx", (F.col("_id") + F.col("_shift")).cast("int")).drop("_id", "_part", "_shift")
