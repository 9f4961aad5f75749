"""Document fingerprints by a randomised edit embedding.

A walk reads a text from its first code point: at step j it writes down the code point it stands on
and moves on if a shared random bit of (j, code point) says so, else it stays. Texts that differ by few edits
soon walk in step again, so the texts written down differ at few places: edit distance became Hamming
distance. The walk is kept as the first step of each code point.

1. A fingerprint has ``BITS`` bits. Bit k belongs to a place of the written text that is drawn, for all
   texts alike, from the places of the text (a consistent draw: two texts of unlike length draw the
   same place with the ratio of their lengths as probability), and is a shared random bit of the
   place and the code point there.
2. The likeness of two fingerprints is 1 - 2 x (unlike bits) / BITS, at least 0: the share of the longer
   written text that agrees.
3. Bands: 16 slices of 32 bits are keys. Only distinct fingerprints take part, and only keys that two of
   them share are looked at; the group of a key that is larger than ``block`` is compared in pairs of
   blocks, and gives a spanning forest of its links, never its pairs.
4. Verification: a link holds if the whole fingerprints are alike at ``least`` or more. At likeness 0.9 a link
   shares a band with probability 0.97 (0.95: 0.9999); linked fingerprints are one class.

Walks run through many texts at once, a code point of each a step; the last few, longest texts are walked
on one by one, in slices. Tasks hold about ``SLICE`` bytes of text, and at least one text.

Defined cases: null is the empty text; all empty texts share one fingerprint; equal texts have equal
fingerprints whatever their keys; rows that share a key or repeat are fingerprinted each; a text whose
bytes are not UTF-8 is read with replacement characters; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tiercat.llm.common import body, col, parts, stored, whole_groups
from tiercat.llm.components import components

BITS, PHASES, CLASSES = 512, 1024, 256
SLICE = 8 << 20
FEW = 24  # texts below this number are walked one by one
FP = "array<long>"
MOST_PLACES = 1 << 40


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit words (all operations modulo 2^64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stays() -> np.ndarray:
    """(PHASES * CLASSES): steps from the first to the last on a code point of a class, by phase."""
    moves = (_mix(np.arange(1, PHASES * CLASSES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
             >> np.uint64(63)).reshape(PHASES, CLASSES).astype(bool)
    out = np.zeros((2 * PHASES + 1, CLASSES), np.int64)
    for j in range(2 * PHASES - 1, -1, -1):
        out[j] = np.where(moves[j % PHASES], 1, out[j + 1] + 1)
    return out[:PHASES].ravel()


def _draws() -> np.ndarray:
    """(BITS, n): for bit k the increasing places it jumps to; of a text with t places, it has the last
    one below t. The place t - 1 is jumped to with probability 1 / t, so every place is as likely."""
    rows = []
    for k in range(BITS):
        place, row, x = 0, [], np.uint64(k + 1)
        while place < MOST_PLACES:
            row.append(place)
            x = _mix(np.array([x], np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0]
            place = int((place + 1) / ((float(x >> np.uint64(11)) + 1) / (1 << 53)))
        rows.append(row)
    out = np.full((BITS, max(map(len, rows)) + 1), np.iinfo(np.int64).max)
    for k, row in enumerate(rows):
        out[k, :len(row)] = row
    return out


class _Tables:
    """The shared random choices, made once a worker."""
    stays = draws = begin = None

    @classmethod
    def load(cls):
        if cls.stays is None:
            cls.stays, cls.draws = _stays(), _draws()
            # where the draws of each bit pass a power of two
            cls.begin = np.stack([(cls.draws < 1 << m).sum(axis=1) - 1 for m in range(42)])
        return cls


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _walks(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first step of every code point, offsets of the texts, steps of each text)."""
    t = _Tables.load()
    size = np.array([len(x) for x in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    kind = ((flat ^ (flat >> 8) * 37) & (CLASSES - 1)).astype(np.int64)
    step = np.zeros(len(flat), np.int64)
    order = np.argsort(-size, kind="stable")
    at, now = begin[:-1][order].copy(), np.zeros(len(size), np.int64)
    longest = size[order]
    lanes, i = int((longest > 0).sum()), 0
    ends = np.cumsum(np.bincount(longest, minlength=1)[::-1])[::-1]  # texts of at least so many code points
    while lanes >= FEW:
        a, j = at[:lanes], now[:lanes]
        step[a] = j
        j += t.stays[(j & (PHASES - 1)) * CLASSES + kind[a]]
        a += 1
        i += 1
        lanes = int(ends[i + 1]) if i + 1 < len(ends) else 0
    stays = t.stays.tolist() if lanes else []
    for k in range(lanes):
        j, last = int(now[k]), int(begin[order[k]] + size[order[k]])
        for a in range(int(at[k]), last, 1 << 16):
            out = []
            for c in kind[a:min(a + (1 << 16), last)].tolist():
                out.append(j)
                j += stays[(j & (PHASES - 1)) * CLASSES + c]
            step[a:a + len(out)] = out
        now[k] = j
    steps = np.zeros(len(size), np.int64)
    steps[order] = now
    return step, begin, steps


def embed(texts: list[str]) -> np.ndarray:
    """(texts, BITS / 64) words of fingerprint."""
    t = _Tables.load()
    points = [_code_points(x) for x in texts]
    step, begin, steps = _walks(points)
    bits = np.arange(BITS)
    level = np.frexp(np.maximum(steps, 1).astype(float))[1] - 1  # 2^level <= steps
    index = t.begin[level]
    while True:
        more = t.draws[bits, index + 1] < steps[:, None]
        if not more.any():
            break
        index += more
    place = np.where(steps[:, None] > 0, t.draws[bits, index], -1)
    symbol = np.full(place.shape, 1 << 21, np.int64)
    for i, x in enumerate(points):
        if len(x):
            symbol[i] = x[step[begin[i]:begin[i + 1]].searchsorted(place[i], "right") - 1]
    h = _mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + symbol.astype(np.uint64))
    h = _mix(h ^ (bits.astype(np.uint64) << np.uint64(48))) >> np.uint64(63)
    packed = np.packbits(h.astype(bool).reshape(len(texts), BITS), axis=1, bitorder="little")
    return packed.view(np.int64).reshape(len(texts), BITS // 64)


def _words(fp: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(fp.ravel()), BITS // 64).cast(pa.list_(pa.int64()))


def _texts(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, fp) of every row."""
    d = docs.select(col(key).alias("key"), body(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in parts(batches, SLICE):
            texts = _texts(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in texts], pa.int64()), _words(embed(texts))],
                ["key", "n_chars", "fp"])

    return d.mapInArrow(run, f"key {d.schema['key'].dataType.simpleString()}, n_chars long, fp {FP}")


def likeness(a: Column, b: Column) -> Column:
    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), 1 - unlike * 2 / F.lit(float(BITS)))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


# --- bands, verification, classes

def _forest(ids: np.ndarray, fps: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Links (u, v) that span every component of the fingerprints within ``most`` unlike bits."""
    us, vs = [], []
    left = np.arange(len(ids))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]).sum(axis=1) <= most
            for y in left[near].tolist():
                us.append(int(ids[x]))
                vs.append(int(ids[y]))
                front.append(y)
            left = left[~near]
    return us, vs


def links(nodes: DataFrame, least: float = 0.9, block: int = 2048) -> DataFrame:
    """Links (u, v) between ``nodes`` (id, fp), distinct fingerprints that share a band and are alike; of
    a group that shares a band only a spanning forest."""
    most = int((1 - least) * BITS / 2)
    half = F.flatten(F.transform("fp", lambda x: F.array(x.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(x, 32))))
    bands = nodes.select("id", F.posexplode(half).alias("band", "bits")).select(
        "id", (F.shiftleft(F.col("band").cast("long"), 32) + F.col("bits")).alias("band"))
    shared = stored(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-bands")
    r = bands.join(shared, "band").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    r = r.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    r = r.select("id", F.xxhash64("band", F.least("side", "other"), F.greatest("side", "other")).alias("g"))
    r = r.join(nodes, "id").repartition("g").sortWithinPartitions("g", "id")

    def run(batches):
        for table in whole_groups(batches, "g"):
            g, ids = table.column("g").to_numpy(), table.column("id").to_numpy()
            fps = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(g), -1)
            cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])).tolist()
            us, vs = [], []
            for a, b in zip(cuts, cuts[1:]):
                u, v = _forest(ids[a:b], fps[a:b], most)
                us += u
                vs += v
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return r.select("g", "id", "fp").mapInArrow(run, "u long, v long").distinct()


def classes(each: DataFrame, least: float = 0.9) -> DataFrame:
    """``each`` (key, fp, ...) with ``class_id``: the smallest key whose fingerprint can be reached over links."""
    nodes = stored(each.groupBy("fp").agg(F.min("key").alias("low"))
                   .withColumn("id", F.monotonically_increasing_id()), "distinct-fingerprints")
    found = components(links(nodes.select("id", "fp"), least))
    roots = stored(nodes.join(found, nodes.id == found.node, "left").select(
        "fp", "low", F.coalesce("root", "id").alias("root")), "fingerprint-roots")
    lowest = roots.groupBy("root").agg(F.min("low").alias("class_id"))
    named = roots.join(lowest, "root").select("fp", "class_id")
    return each.join(named, "fp").select(*each.columns, "class_id")


# --- every text against an edited one: its last part gives way to the beginning of the next text

class _Held:
    """A row that waits for the next one."""
    __slots__ = ("key", "text", "fp", "place")

    def __init__(self, key, text, fp, place):
        self.key, self.text, self.fp, self.place = key, text, fp, place


def edited(text: str, after: str, share: int) -> str:
    cut = len(text) // share
    return text[:len(text) - cut] + after[:cut]


def _schema(key_type: str) -> str:
    return (f"part int, key {key_type}, n_chars long, fp {FP}, edited_sha256 string, edited_fp {FP}, next_fp {FP}, "
            "first boolean, body binary")


def _rows(rows: list[_Held], after: list[_Held | None], part: int, share: int, key_type: pa.DataType) -> pa.RecordBatch:
    """Output rows; a row without the next one keeps its body, and so does the part's first."""
    know = [i for i, x in enumerate(after) if x is not None]
    new = [edited(rows[i].text, after[i].text, share) for i in know]
    fps = dict(zip(know, embed(new))) if know else {}
    sha = dict(zip(know, (hashlib.sha256(x.encode()).hexdigest() for x in new)))
    listed = lambda x: None if x is None else x.tolist()
    bodies = [zlib.compress(r.text.encode(), 1) if r.place == 0 or after[i] is None else None for i, r in enumerate(rows)]
    long_list = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.array([part] * len(rows), pa.int32()), pa.array([r.key for r in rows], key_type),
        pa.array([len(r.text) for r in rows], pa.int64()), pa.array([listed(r.fp) for r in rows], long_list),
        pa.array([sha.get(i) for i in range(len(rows))], pa.string()),
        pa.array([listed(fps.get(i)) for i in range(len(rows))], long_list),
        pa.array([listed(x.fp) if x else None for x in after], long_list),
        pa.array([r.place == 0 for r in rows], pa.bool_()), pa.array(bodies, pa.binary())],
        ["part", "key", "n_chars", "fp", "edited_sha256", "edited_fp", "next_fp", "first", "body"])


def against_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 3) -> DataFrame:
    """(key, n_chars, edited_sha256, fp, edited_fp, next_fp) of every row: the last 1 / ``share`` of its code points
    give way to as many (or all) of the next row's first, in descending order of key and text hash, null keys
    last; the first row comes after the last.

    Texts travel once, compressed, dealt by ranges of the order; a range streams through its task, and only
    the first and the last row of each range meet those of the neighbouring ranges."""
    d = docs.select(col(key).alias("key"), F.xxhash64(body(text)).alias("tid"),
                    F.monotonically_increasing_id().alias("no"), body(text).alias("body"))
    kind = d.schema["key"].dataType.simpleString()

    def pack(batches):
        for b in parts(batches, SLICE):
            z = [zlib.compress(x, 1) for x in b.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z, pa.binary())], ["key", "tid", "no", "body"])

    order = [F.col("key").desc_nulls_last(), F.col("tid"), F.col("no")]
    ranges = d.mapInArrow(pack, f"key {kind}, tid long, no long, body binary") \
        .repartitionByRange(*order).sortWithinPartitions(*order).select("key", "body")

    def walk(batches):
        part, held, place = TaskContext.get().partitionId(), None, 0
        key_type = pa.int64()
        for b in parts(batches, SLICE // 2):
            key_type = b.column(0).type
            texts = [zlib.decompress(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            fps = embed(texts)
            now = [_Held(k, x, f, place + i) for i, (k, x, f) in enumerate(zip(b.column(0).to_pylist(), texts, fps))]
            place += len(now)
            line = ([held] if held else []) + now
            if len(line) > 1:
                yield _rows(line[:-1], line[1:], part, share, key_type)
            held = line[-1] if line else None
        if held:
            yield _rows([held], [None], part, share, key_type)

    each = stored(ranges.mapInArrow(walk, _schema(kind)), "walked")
    # a row a range: its last row meets the first of the next range that holds any
    firsts = each.where("first").select("part", F.col("fp").alias("f_fp"), F.col("body").alias("f_body"))
    order = Window.orderBy("part")
    next_part = F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy()))
    to = firsts.select("part", next_part.alias("next"))
    ends = each.where("next_fp IS NULL").select("part", "key", "fp", "body", "first").join(to, "part").join(
        firsts.withColumnRenamed("part", "next"), "next").select("part", "key", "fp", "body", "f_fp", "f_body", "first")

    def close(batches):
        read = lambda z: zlib.decompress(z).decode("utf-8", "replace")
        for b in batches:
            for r in b.to_pylist():
                row = _Held(r["key"], read(r["body"]), np.array(r["fp"]), 0 if r["first"] else 1)
                nxt = _Held(None, read(r["f_body"]), np.array(r["f_fp"]), 0)
                yield _rows([row], [nxt], r["part"], share, b.column(1).type)

    whole = each.where("next_fp IS NOT NULL").unionByName(ends.mapInArrow(close, _schema(kind)))
    return whole.select("key", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")
