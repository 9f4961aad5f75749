"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their white space runs become one space. A
document holds an item if some stretch of it is within the item's error budget,
floor(length * errors), of the whole item in edit distance. An item is split into budget + 1
pieces; one of them must stand unchanged in the stretch, so exact piece hits (one
Aho-Corasick pass over the text) give every place worth looking at, and Myers' bit-parallel
distance decides there.

Items travel to the tasks in blocks of at most ``block_chars`` characters, a proven size; a
larger benchmark takes one pass over the documents per block, each written before the next
begins, so neither the driver nor a task holds more than a block.

An item too short for one error (under 20 characters at 5 %) must stand unchanged, and between word borders:
the item "yes" is not held by "yesterday".

Defined cases: null and blank items hold nothing and match nothing; null and empty texts
match nothing; items that repeat an id or a text are matched each; repeated documents are
reported each.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tiercat.llm.common import body, col, parts, stored, texts_of


def normal(raw: bytes) -> str:
    return " ".join(raw.decode("utf-8", "replace").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(start, piece) of budget + 1 pieces of nearly equal length that make up the item."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least distance, end of the first such place) of ``pattern`` against any stretch of
    ``text``: Myers' column vectors as whole integers, one step per character."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    up, down, distance = mask, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | (~(diagonal | up) & mask)
        minus = up & diagonal
        if plus & high:
            distance += 1
        elif minus & high:
            distance -= 1
        # a match may begin anywhere: the row above the first stays 0
        plus = (plus << 1) & mask
        minus = (minus << 1) & mask
        up = minus | (~((eq | down) | plus) & mask)
        down = plus & (eq | down)
        if distance < best:
            best, end = distance, j
    return best, end


def _word_at(item: str, text: str, a: int, b: int) -> int:
    """The first place of ``item`` in text[a:b] where no letter or digit goes on at either end, or -1."""
    at = text.find(item, a, b)
    while at >= 0:
        end = at + len(item)
        if not (at and text[at - 1].isalnum() and item[0].isalnum()) \
                and not (end < len(text) and text[end].isalnum() and item[-1].isalnum()):
            return at
        at = text.find(item, at + 1, b)
    return -1


class Matcher:
    """The items of one block with the automaton of their pieces."""

    def __init__(self, items: list[tuple[object, str]], errors: float):
        self.items = [(i, t, int(len(t) * errors)) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, budget) in enumerate(self.items):
            for start, piece in pieces(t, budget):
                found.setdefault(piece, []).append((k, start))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalised text) of every item that the text holds."""
        if self.empty or not text:
            return []
        spans: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for k, start in places:
                begin = last + 1 - size - start
                _, item, budget = self.items[k]
                a, b = max(0, begin - budget), begin + len(item) + budget
                held = spans.setdefault(k, [])
                if held and a <= held[-1][1] and held[-1][0] <= b:
                    held[-1][0], held[-1][1] = min(a, held[-1][0]), max(b, held[-1][1])
                else:
                    held.append([a, b])
        out = []
        for k, windows in spans.items():
            _, item, budget = self.items[k]
            best = None
            for a, b in windows:
                if not budget:
                    at = _word_at(item, text, a, b)
                    if at >= 0:
                        best = (k, 0, at + len(item))
                        break
                    continue
                at = text.find(item, a, b)
                d, end = (0, at + len(item)) if at >= 0 else myers(item, text[a:b])
                if d <= budget and (best is None or d < best[1]):
                    best = (k, d, end if at >= 0 else a + end)
                if best and best[1] == 0:
                    break
            if best:
                out.append(best)
        return out


def blocks(benchmark: DataFrame, item: str, text: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks, streamed partition by partition."""
    held, size = [], 0
    rows = benchmark.select(col(item).alias("item"), body(text).alias("text"))
    for row in rows.toLocalIterator():
        t = normal(row["text"].encode())
        if not t:
            continue
        if held and size + len(t) > block_chars:
            yield held
            held, size = [], 0
        held.append((row["item"], t))
        size += len(t)
    yield held


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
            item: str = "item_id", item_text: str = "text", errors: float = 0.05,
            block_chars: int = 1_000_000) -> DataFrame:
    """(key, item, distance, end) per document and item that it holds."""
    d = docs.select(col(key).alias("key"), col(text).cast("string").alias("text"))
    item_field = benchmark.select(col(item).alias("item")).schema["item"]
    schema = f"key {d.schema['key'].dataType.simpleString()}, item {item_field.dataType.simpleString()}, " \
             "distance int, end long"
    types = [pa.int32(), pa.int64()]

    def one(block):
        def run(batches):
            m = Matcher(block, errors)
            for b in parts(batches):
                hits = [(i, *x) for i, t in enumerate(texts_of(b.column(1))) for x in m.matches(normal(t))]
                if not hits:
                    continue
                rows, which, distance, end = zip(*hits)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array([block[k][0] for k in which]),
                     pa.array(distance, types[0]), pa.array(end, types[1])],
                    ["key", "item", "distance", "end"])
        return d.mapInArrow(run, schema)

    out, before = None, None
    for block in blocks(benchmark, item, item_text, block_chars):
        if before is not None:
            done = stored(before, "matches")
            out = done if out is None else out.unionByName(done)
        before = one(block)
    return before if out is None else out.unionByName(before)


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
               item: str = "item_id", item_text: str = "text", errors: float = 0.05,
               block_chars: int = 1_000_000) -> DataFrame:
    """The documents that hold no item, all columns. Rows are judged by their own text, in one
    pass per block, so nothing is shuffled; what a block leaves is written before the next begins."""
    out = None
    for block in blocks(benchmark, item, item_text, block_chars):
        out = _without(docs if out is None else stored(out, "clean"), text, block, errors)
    return out


def _without(docs: DataFrame, text: str, block, errors: float) -> DataFrame:
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(block, errors)
        for texts in batches:
            yield pd.Series([not m.matches(normal((t or "").encode())) for t in texts], dtype=bool)

    return docs.where(clean(col(text).cast("string")))
