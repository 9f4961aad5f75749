"""Removal of byte strings that repeat, by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
text or another; strings never cross texts, overlaps count, and all is judged on the input.

Sorting every suffix of a corpus together would move it many times over, so suffixes are first
dealt out by content. The anchor of a string is the leftmost smallest hash among its
``anchor``-byte parts; equal strings have equal anchors at equal places. Neighbouring strings with
one anchor are a run, so a text becomes a few runs per 300 bytes, and a string can repeat only in
a run with the same anchor hash.

1. Runs (hashes and places, no bytes) are counted by anchor hash; single ones are done.
2. Runs of equal bytes are one class, told by a cryptographic digest of 128 bits, for which nobody can
   make two texts collide and 10^12 runs do with a probability of 10^-15; a class seen twice goes as a whole.
3. Of anchors with several classes, the bytes of one run per class are fetched, and the suffixes
   that start in them are sorted: a vectorised mergesort whose comparisons find the common
   extension of two suffixes by binary search over polynomial prefix hashes. Neighbours in
   order that agree on ``length`` bytes repeat. Their bytes are compared, so a hash
   collision cannot remove anything in this step; texts with one are compared byte by byte instead.
4. An anchor with more than ``most_classes`` classes (a phrase common to very many texts) is not
   sorted in one task: its runs are dealt out again by longer anchors, at last by the whole
   string, where equal hashes count and nothing is left to sort. That is exact at any size.

Defined cases: a null text is empty and loses nothing; texts shorter than ``length`` lose
nothing; rows that repeat key and text are texts of their own, so both lose what they share; a
null key is a key; an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tiercat.llm.common import body, col, parts, stored, texts_of, whole_groups

BASE = 0x9E3779B97F4A7C15 | 1
PLACE_BITS = 20
CHUNK = 1 << PLACE_BITS
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64."""
    out = np.ones(n, np.uint64)
    done, step = 1, base % (1 << 64)
    while done < n:
        take = min(done, n - done)
        out[done:done + take] = out[:take] * np.uint64(step)
        done += take
        step = step * step % (1 << 64)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Dealer:
    """Runs of texts: for each, its place, its length, its anchor's place in it, and hashes."""

    def __init__(self, length: int, anchor: int):
        self.length, self.anchor, self.window = length, anchor, length - anchor + 1
        self.up, self.down = _powers(BASE, CHUNK + 1), _powers(_INVERSE, CHUNK + 1)

    def pieces(self, texts: list[bytes]):
        """Texts in groups of at most CHUNK bytes: [(row, place in the text, bytes)]. A longer text
        is cut into pieces that overlap by length - 1, so every string is in exactly one."""
        group, size = [], 0
        stride = CHUNK - self.length + 1
        for row, t in enumerate(texts):
            if len(t) < self.length:
                continue
            for a in range(0, max(1, len(t) - self.length + 1), stride):
                part = t[a:a + CHUNK] if len(t) > CHUNK else t
                if group and size + len(part) > CHUNK:
                    yield group
                    group, size = [], 0
                group.append((row, a, part))
                size += len(part)
        if group:
            yield group

    def runs(self, group):
        """Arrays (row, place, bytes, anchor place, anchor hash, content hash x 2) of a group."""
        raw = b"".join(p for _, _, p in group)
        n, k, w = len(raw), self.anchor, self.window
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = _mixed((sums[k:] - sums[:-k]) * self.down[:n - k + 1])
        low = np.uint64(CHUNK - 1)
        keyed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        least = self._sliding(keyed, w)
        sizes = np.array([len(p) for _, _, p in group])
        starts = np.cumsum(sizes) - sizes
        whole = np.zeros(n + 1, np.int64)
        np.add.at(whole, starts, 1)
        np.add.at(whole, starts + sizes - self.length + 1, -1)
        at = np.flatnonzero(np.cumsum(whole[:len(least)]))
        anchor = (least[at] & low).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        begin, end = at[first], at[last] + self.length
        content = np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=16).digest()
                                          for a, b in zip(begin.tolist(), end.tolist())]), "<i8").reshape(-1, 2)
        owner = np.searchsorted(starts, begin, side="right") - 1
        rows = np.array([r for r, _, _ in group])[owner]
        place = begin - starts[owner] + np.array([a for _, a, _ in group])[owner]
        return (rows, place, end - begin, anchor[first] - begin, h[anchor[first]].view(np.int64),
                content[:, 0], content[:, 1])

    @staticmethod
    def once(rows, place, size, off, h, c1, c2):
        """The runs with those of equal bytes in one text told once, and the ranges of all that a
        text holds twice: a text that repeats a short phrase has thousands of equal runs."""
        order = np.lexsort((place, c2, c1, rows))
        r, a, b = rows[order], c1[order], c2[order]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (r[1:] == r[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        again = np.zeros(len(order), bool)
        again[order] = same[:-1] | same[1:]
        first = np.zeros(len(order), bool)
        first[order] = ~same[:-1]
        at = np.flatnonzero(again)
        at = at[np.lexsort((place[at], rows[at]))]
        owner, begin, end = rows[at], place[at], place[at] + size[at]
        # runs of a text stand in order and end in order, so a gap is where one begins past the last end
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (begin[1:] > end[:-1])
        i = np.flatnonzero(new)
        j = np.append(i[1:], len(at))[:len(i)] - 1
        zero = np.zeros(len(i), np.int64)
        known = (owner[i], begin[i], end[j] - begin[i], zero, zero, zero, zero)
        keep = np.flatnonzero(first)
        return [np.concatenate([x[keep], y]) for x, y in zip((rows, place, size, off, h, c1, c2), known)], \
            np.arange(len(keep) + len(i)) >= len(keep)

    @staticmethod
    def _sliding(x: np.ndarray, w: int) -> np.ndarray:
        """Minimum of every w neighbours, from running minima within blocks of w."""
        if w == 1:
            return x
        n = len(x)
        padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = x
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def runs(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(key, tid, place, size, off, h, c1, c2, known) of ``texts`` (key, tid, body): runs, and (known)
    ranges that one text alone shows to repeat."""
    def run(batches):
        dealer = Dealer(length, anchor)
        for b in parts(batches):
            for group in dealer.pieces(texts_of(b.column(2))):
                (rows, *rest), known = dealer.once(*dealer.runs(group))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at)]
                    + [pa.array(x.astype(t)) for x, t in zip(rest, "i8 i8 i4 i8 i8 i8".split())]
                    + [pa.array(known)],
                    ["key", "tid", "place", "size", "off", "h", "c1", "c2", "known"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "tid", "body").mapInArrow(
        run, f"key {kind}, tid long, place long, size long, off int, h long, c1 long, c2 long, known boolean")


class Suffixes:
    """The suffixes that start in a set of classes, sorted among those that can be equal."""

    def __init__(self, contents: list[bytes], group: np.ndarray, off: np.ndarray, length: int):
        self.contents, self.length = contents, length
        sizes = np.array([len(c) for c in contents], np.int64)
        self.start = np.cumsum(sizes) - sizes
        raw = b"".join(contents)
        self.bytes = np.frombuffer(raw, np.uint8)
        local = np.arange(len(raw)) - np.repeat(self.start, sizes)
        longest = int(sizes.max()) + 1
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * _powers(BASE, longest)[local], out=self.sums[1:])
        self.down = _powers(_INVERSE, longest)
        # one suffix per string start; segments are the same distance before the same anchor
        n = sizes - length + 1
        self.owner = np.repeat(np.arange(len(contents)), n)
        self.place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        before = off[self.owner] - self.place
        order = np.lexsort((before, group[self.owner]))
        key = group[self.owner[order]], before[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order)))
        keep = np.repeat(count > 1, count)
        self.order = order[keep]
        count = count[count > 1]
        self.first = np.repeat(np.cumsum(count) - count, count)
        self.count = np.repeat(count, count)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension, up to ``length``, of suffixes a and b."""
        pa_, pb = self.place[a], self.place[b]
        sa, sb = self.start[self.owner[a]] + pa_, self.start[self.owner[b]] + pb
        ha, hb = self.sums[sa], self.sums[sb]
        da, db = self.down[pa_], self.down[pb]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length, np.int64)
        while True:
            if not (low < high).any():
                return low
            mid = (low + high + 1) >> 1
            same = (self.sums[sa + mid] - ha) * da == (self.sums[sb + mid] - hb) * db
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)

    def above(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffix a stands after b, and whether they agree on ``length`` bytes."""
        c = self.common(a, b)
        equal = c >= self.length
        c = np.minimum(c, self.length - 1)
        xa = self.bytes[self.start[self.owner[a]] + self.place[a] + c]
        xb = self.bytes[self.start[self.owner[b]] + self.place[b] + c]
        return (xa > xb) & ~equal, equal

    def sort(self) -> None:
        """Bottom-up mergesort of all segments at once: an element's place in the merged run is its
        own place plus its rank in the other run, found by binary search."""
        rank = np.arange(len(self.order)) - self.first
        width = 1
        while True:
            live = np.flatnonzero(self.count > width)
            if not len(live):
                return
            r, first, count = rank[live], self.first[live], self.count[live]
            block = r // (2 * width) * (2 * width)
            left = r - block < width
            low = np.where(left, np.minimum(block + width, count), block)
            high = np.where(left, np.minimum(block + 2 * width, count), np.minimum(block + width, count))
            base = low.copy()
            me = self.order[live]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                after, equal = self.above(me[open_], self.order[first[open_] + mid])
                # the left run goes first among equals
                up = after | (equal & ~left[open_])
                low[open_] = np.where(up, mid + 1, low[open_])
                high[open_] = np.where(up, high[open_], mid)
            own = np.where(left, r - block, r - block - width)
            self.order[first + block + own + (low - base)] = me
            width *= 2

    def repeated(self) -> dict[int, list[tuple[int, int]]]:
        """Of every class: ranges (first, end) of the bytes whose strings repeat in another."""
        if not len(self.order):
            return {}
        self.sort()
        inner = np.flatnonzero(self.first[1:] == self.first[:-1])
        a, b = self.order[inner], self.order[inner + 1]
        equal = self.common(a, b) >= self.length
        a, b = a[equal], b[equal]
        # verify by bytes: strings of neighbouring places with the same partner at the same distance
        # are one stretch
        x, y, p, q = self.owner[a], self.owner[b], self.place[a], self.place[b]
        by = np.lexsort((p, q - p, y, x))
        x, y, p, q = x[by], y[by], p[by], q[by]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(x)) - 1
        out: dict[int, list[tuple[int, int]]] = {}
        for i, j in zip(first.tolist(), last.tolist()):
            n = int(p[j] - p[i]) + self.length
            u, v, pu, pv = int(x[i]), int(y[i]), int(p[i]), int(q[i])
            if self.contents[u][pu:pu + n] != self.contents[v][pv:pv + n]:
                return self._byte_by_byte()
            out.setdefault(u, []).append((pu, pu + n))
            out.setdefault(v, []).append((pv, pv + n))
        return out

    def _byte_by_byte(self) -> dict[int, list[tuple[int, int]]]:
        seen: dict[bytes, list[tuple[int, int]]] = {}
        for u, c in enumerate(self.contents):
            for p in range(len(c) - self.length + 1):
                seen.setdefault(c[p:p + self.length], []).append((u, p))
        out: dict[int, list[tuple[int, int]]] = {}
        for places in seen.values():
            if len(places) > 1:
                for u, p in places:
                    out.setdefault(u, []).append((p, p + self.length))
        return out


def _fetched(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``classes`` (h, c1, c2, at: key, tid, place, size, off) with their bytes: one run per class is
    cut from its text. Rows that repeat key and text bring the same classes again."""
    at = classes.select(F.col("at.key").alias("k"), F.col("at.tid").alias("t"), F.struct(
        F.col("at.place").alias("place"), F.col("at.size").alias("size"), F.col("at.off").alias("off"),
        "h", "c1", "c2").alias("r"))
    at = at.groupBy("k", "t").agg(F.collect_list("r").alias("r"))
    d = texts.join(at, F.col("key").eqNullSafe(F.col("k")) & (F.col("tid") == F.col("t"))).select("body", "r")
    return d.select("body", F.explode("r").alias("r")).select(
        "r.h", "r.c1", "r.c2", "r.off",
        F.substring(F.col("body"), (F.col("r.place") + 1).cast("int"), F.col("r.size").cast("int")).alias("bytes"))


def _sorted_out(pieces: DataFrame, length: int) -> DataFrame:
    """(c1, c2, a, b): ranges of the classes ``pieces`` (h, c1, c2, off, bytes) that repeat."""
    p = pieces.repartition("h").sortWithinPartitions("h")

    def run(batches):
        for table in whole_groups(batches, "h"):
            h = table.column("h").to_numpy()
            c1, c2 = table.column("c1").to_numpy(), table.column("c2").to_numpy()
            _, single = np.unique(np.stack([h, c1, c2]), axis=1, return_index=True)
            table = table.take(pa.array(np.sort(single)))
            h, c1, c2 = (table.column(x).to_numpy() for x in ("h", "c1", "c2"))
            off = table.column("off").to_numpy().astype(np.int64)
            for a, b in _slices(h, pc.binary_length(table.column("bytes")).to_numpy()):
                raw = table.column("bytes").slice(a, b - a).to_pylist()
                found = Suffixes(raw, h[a:b], off[a:b], length).repeated()
                rows = [(a + u, *r) for u, rs in found.items() for r in merged(rs)]
                if rows:
                    u, first, end = (np.array(x) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c1[u]), pa.array(c2[u]), pa.array(first), pa.array(end)], ["c1", "c2", "a", "b"])

    return p.mapInArrow(run, "c1 long, c2 long, a long, b long")


def merged(ranges) -> list[tuple[int, int]]:
    """The union of ranges as maximal ranges in order."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _slices(h: np.ndarray, sizes: np.ndarray, most: int = 1 << 21):
    """Ranges of rows with whole groups and about ``most`` bytes, which bounds the sort's memory."""
    cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1])).tolist() + [len(h)]
    a, held = 0, 0
    for x, y in zip(cuts, cuts[1:]):
        n = int(sizes[x:y].sum())
        if held and held + n > most:
            yield a, x
            a, held = x, 0
        held += n
    if held:
        yield a, len(h)


def repeats(texts: DataFrame, length: int = 400, anchors: tuple[int, ...] = (64, 240, 340),
            most_classes: int = 1024) -> DataFrame:
    """(key, tid, a, b): byte ranges of ``texts`` (key, tid, body binary) that go; ranges overlap."""
    anchor = min(anchors[0], length) if anchors else length
    dealt = stored(runs(texts, length, anchor), "runs")
    r = dealt.where("NOT known").drop("known")
    many = r.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c1").alias("lo"), F.max("c1").alias("hi"),
                              F.min("c2").alias("lo2"), F.max("c2").alias("hi2")).where("n > 1") \
        .select("h", ((F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2"))).alias("same"))
    met = stored(r.join(many, "h"), "met-runs")
    span = lambda d: d.select(
        "key", "tid", F.col("place").alias("a"), (F.col("place") + F.col("size")).alias("b"))
    out = span(dealt.where("known")).unionByName(span(met.where("same")))
    mixed = met.where("NOT same")
    classes = stored(mixed.groupBy("h", "c1", "c2").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct("key", "tid", "place", "size", "off")).alias("at")), "run-classes")
    again = classes.where("copies > 1").select("h", "c1", "c2")
    out = out.unionByName(span(mixed.join(again, ["h", "c1", "c2"])))
    if anchor >= length:
        return out
    crowds = classes.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most_classes).select("h")
    crowds = stored(crowds, "crowds")
    pieces = stored(_fetched(texts, classes), "run-bytes")
    found = [_sorted_out(pieces.join(crowds, "h", "left_anti"), length)]
    if not crowds.isEmpty():
        crowd = stored(pieces.join(crowds, "h", "left_semi").dropDuplicates(["c1", "c2"]), "crowd-runs")
        deeper = repeats(crowd.select(F.col("c1").alias("key"), F.col("c2").alias("tid"), F.col("bytes").alias("body")),
                         length, anchors[1:], most_classes)
        found.append(deeper.select(F.col("key").alias("c1"), F.col("tid").alias("c2"), "a", "b"))
    for part in found:
        ranges = part.groupBy("c1", "c2").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
        hit = mixed.join(ranges, ["c1", "c2"]).select("key", "tid", "place", F.explode("ranges").alias("x"))
        out = out.unionByName(hit.select(
            "key", "tid", (F.col("place") + F.col("x.a")).alias("a"), (F.col("place") + F.col("x.b")).alias("b")))
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400,
          anchors: tuple[int, ...] = (64, 240, 340), most_classes: int = 1024) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, removed (array of first and end of every maximal
    removed run) and kept (the bytes left)."""
    texts = docs.select(col(key).alias("key"), F.xxhash64(body(text)).alias("tid"),
                        body(text).cast("binary").alias("body"))
    found = repeats(texts, length, anchors, most_classes).groupBy("key", "tid") \
        .agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    found = found.withColumnsRenamed({"key": "k", "tid": "t"})
    d = texts.join(found, F.col("key").eqNullSafe(F.col("k")) & (F.col("tid") == F.col("t")), "left") \
        .select("key", "body", F.sort_array("ranges").alias("ranges"))
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in parts(batches):
            spans, kept, sizes = [], [], []
            for raw, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                gone = merged((r["a"], r["b"]) for r in ranges or ())
                at, left = 0, []
                for x, y in gone:
                    left.append(raw[at:x])
                    at = y
                spans.append([{"first": x, "end": y} for x, y in gone])
                kept.append(b"".join(left) + raw[at:] if gone else raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                ["key", "n_bytes", "removed", "kept"])

    kind = texts.schema["key"].dataType.simpleString()
    return d.mapInArrow(
        run, f"key {kind}, n_bytes long, removed array<struct<first:bigint,end:bigint>>, kept binary")
