"""SimHash near-duplicates by anchor-point covering.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's
word shingles. Two fingerprints of 64 bits within 3 bits differ by at most 1 bit in one of their
halves, so each half is covered on its own: the anchors of a half are the words of the [31, 26]
Hamming code with the half's last bit kept as it is, a code of covering radius 1. A
fingerprint's home in a half is its nearest anchor; it is replicated to every anchor within
covering radius + threshold = 2 bits, which are 17 per half. Two fingerprints whose halves
differ by at most 1 bit meet where one of them is at home, and there all 64 bits are compared.

Equal fingerprints are one node from the start, so copies are never compared. An anchor with
more than ``block`` fingerprints is cut into blocks by hash, and each pair of blocks is a
group of its own: memory stays bounded and the work of a hot anchor is spread. A large group
reports a spanning forest of its links instead of all of them, which leaves components as
they are.

Defined cases: a null or empty text has fingerprint 0, linked like any other; a text with fewer
words than a shingle is one shingle; a null key is a key like any other and never the
smallest of a component that has another; repeated rows are one node and appear each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tiercat.llm.common import body, col, lower_words, parts, stored, texts_of, whole_groups
from tiercat.llm.components import components


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    words = lower_words(raw)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())],
                      dtype=np.uint64)
    bits = np.unpackbits(hashes.byteswap().view(np.uint8).reshape(n, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp long) of every row."""
    d = docs.select(col(key).alias("key"), col(text).cast("string").alias("text"))

    def run(batches):
        for b in parts(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts_of(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["key", "fp"])

    return d.mapInArrow(run, f"key {d.schema['key'].dataType.simpleString()}, fp long")


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Syndrome of the first 31 bits: the xor of the positions (1 to 31) of its set bits."""
    out = np.zeros(len(half), np.uint64)
    for i in range(31):
        out ^= np.where((half >> np.uint64(i)) & np.uint64(1), np.uint64(i + 1), np.uint64(0))
    return out


def _flip(positions: np.ndarray) -> np.ndarray:
    """The word with a 1 at each position (1 to 31), 0 for position 0."""
    return np.where(positions > 0, np.uint64(1) << (positions - (positions > 0)).astype(np.uint64),
                    np.uint64(0))


def anchors(half: np.ndarray) -> np.ndarray:
    """(rows, 17): every anchor within 2 bits of each 32-bit half, the nearest one first.

    The nearest anchor undoes the error position s that the syndrome tells. An anchor at two
    bits' distance comes from flipping positions i and j with i xor j = s, 15 pairs for s > 0;
    for s = 0 no such pair exists, the word is an anchor itself, and the other 15 places repeat
    it. The last is the nearest one with the 32nd bit flipped.
    """
    s = _syndrome(half)
    home = half ^ _flip(s)
    out = np.repeat(home[:, None], 17, axis=1)
    column = np.ones(len(half), np.int64)
    rows = np.arange(len(half))
    for i in range(1, 32):
        j = s ^ np.uint64(i)
        use = (s > 0) & (j > i)
        out[rows[use], column[use]] = half[use] ^ _flip(np.full(use.sum(), i, np.uint64)) ^ _flip(j[use])
        column[use] += 1
    out[:, 16] = home ^ np.uint64(1 << 31)
    return out


def replicas(nodes: DataFrame) -> DataFrame:
    """(anchor, fp, home) of ``nodes`` (fp): both halves, every anchor once."""
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            wide = fp.view(np.uint64)
            for which, half in enumerate((wide & np.uint64(0xFFFFFFFF), wide >> np.uint64(32))):
                a = anchors(half).astype(np.int64) | (which << 32)
                once = np.ones(a.shape, bool)
                once[:, 1:16] = a[:, 1:16] != a[:, :1]
                at = np.nonzero(once)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[at]), pa.array(fp[at[0]]), pa.array(at[1] == 0)], ["anchor", "fp", "home"])

    return nodes.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _near(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= max_bits


def _forest(fp: np.ndarray, home: np.ndarray, max_bits: int):
    """Links (u, v) that span every component of one group."""
    n = len(fp)
    label = np.arange(n)
    near = []
    for a in range(0, n, 512):
        ok = _near(fp[a:a + 512, None], fp[None, :], max_bits) & (home[a:a + 512, None] | home[None, :])
        near.append(np.packbits(ok, axis=1))
    while True:
        new = label.copy()
        for k, packed in enumerate(near):
            ok = np.unpackbits(packed, axis=1, count=n).astype(bool)
            low = np.where(ok, label[None, :], n).min(axis=1)
            new[k * 512:k * 512 + len(low)] = np.minimum(new[k * 512:k * 512 + len(low)], low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    rows = np.nonzero(label != np.arange(n))[0]
    return fp[rows], fp[label[rows]]


def _links(table: pa.Table, max_bits: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    g = table.column("g").to_numpy()
    fp = table.column("fp").to_numpy().view(np.uint64)
    home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
    start = np.nonzero(np.concatenate([[True], g[1:] != g[:-1]]))[0]
    size = np.diff(np.concatenate([start, [len(g)]]))
    us, vs = [], []
    for a, n in zip(start[size > small].tolist(), size[size > small].tolist()):
        u, v = _forest(fp[a:a + n], home[a:a + n], max_bits)
        us.append(u)
        vs.append(v)
    # small groups: row k of a group against row k + d of it, for every distance d
    owner = np.repeat(size, size)
    place = np.arange(len(g)) - np.repeat(start, size)
    for d in range(1, small):
        i = np.nonzero((owner <= small) & (place + d < owner))[0]
        if not len(i):
            break
        j = i + d
        ok = _near(fp[i], fp[j], max_bits) & (home[i] | home[j])
        us.append(fp[i[ok]])
        vs.append(fp[j[ok]])
    u, v = (np.concatenate(z) if z else np.zeros(0, np.uint64) for z in (us, vs))
    return u.view(np.int64), v.view(np.int64)


def links(nodes: DataFrame, max_bits: int = 3, block: int = 2048) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``nodes`` (fp) within ``max_bits`` <= 3 bits;
    of a large group only a spanning forest."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with anchors of radius 1 cover at most 3 bits")
    r = stored(replicas(nodes), "anchors")
    hot = r.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block) \
        .select("anchor", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    r = r.join(hot, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    r = (r.withColumn("side", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
         .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    # one number names the anchor and the pair of blocks; anchors take 33 bits
    first, second = F.least("side", "other"), F.greatest("side", "other")
    r = r.select(F.xxhash64("anchor", first, second).alias("g"), "fp", "home")
    r = r.repartition("g").sortWithinPartitions("g")

    def run(batches):
        for table in whole_groups(batches, "g"):
            u, v = _links(table, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return r.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: key, fp, component (the smallest key reachable)."""
    each = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    nodes = each.groupBy("fp").agg(F.min("key").alias("low"))
    found = stored(components(links(nodes, max_bits)), "components")
    roots = nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    roots = stored(roots, "roots")
    smallest = roots.groupBy("root").agg(F.min("low").alias("component"))
    named = roots.select("fp", "root").join(smallest, "root").select("fp", "component")
    return each.join(named, "fp").select("key", "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
             max_bits: int = 3, distinct_keys: bool = False) -> DataFrame:
    """The documents with one row of each component kept, all columns: the smallest (key, text hash),
    null keys last; of rows equal in both, one. Different texts under one key, null included, are
    documents of their own. ``distinct_keys`` keeps besides only one row of each key that is not
    null, the one with the smallest text hash."""
    tid = F.xxhash64(body(text))
    row = F.struct(col(key).isNull().alias("no_key"), col(key).alias("key"), tid.alias("tid"))
    n = near_duplicates(docs.select(row.alias("key"), col(text).alias("text")), "key", "text", shingle, max_bits)
    kept = n.where(F.col("key") == F.col("component")).select(
        F.col("key.key").alias("key"), F.col("key.tid").alias("tid")).distinct().alias("k")
    d = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(key).alias("key"),
                    tid.alias("tid")).alias("d")
    d = d.join(kept, F.col("d.key").eqNullSafe(F.col("k.key")) & (F.col("d.tid") == F.col("k.tid")), "left_semi")
    d = d.withColumn("no", F.row_number().over(Window.partitionBy("key", "tid").orderBy(F.lit(0)))).where("no = 1")
    if distinct_keys:
        w = Window.partitionBy("key", F.when(F.col("key").isNull(), F.col("tid"))).orderBy("tid")
        d = d.withColumn("no", F.row_number().over(w)).where("no = 1")
    return d.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
