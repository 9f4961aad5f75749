"""Edit-aware token counts.

A text is cut into pre-tokens by the tokenizer's pattern and each is encoded on its own, so a
text's count is the sum over its pre-tokens. Every document keeps a segment tree over runs of
``LEAF`` pre-tokens: a node holds the characters and the tokens below it. An edit (at, drop, put)
re-encodes from the leaf that holds the edit, less two characters of context that the
pattern may look ahead, until a new pre-token border falls on an old leaf border behind the
edit; from there on all borders are the old ones. The changed leaves are set and the sums on
their paths to the root updated; nothing else is read or encoded.

The tokenizer is a public vocabulary file, given by path and read on the driver; its ranks (about
1 MB) travel to the tasks. Pre-token counts are remembered per task, up to ``REMEMBERED``.

Defined cases: a null text is empty and has 0 tokens; a null list of edits is empty; an edit with
a null part takes 0 or the empty text for it; places beyond the end mean the end; edits apply
one after the other, each to the text that the former left; repeated rows are counted each.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from tiercat.llm.common import col, parts

# The public byte-level BPE's pre-token pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 32
REMEMBERED = 300_000
AHEAD = 2


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Counter:
    """Tokens of pre-tokens, remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def leaves(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Characters and tokens of every run of LEAF pre-tokens, and the number of pre-tokens."""
        parts = self.find.findall(text)
        if not parts:
            return np.zeros(1, np.int64), np.zeros(1, np.int64), 0
        at = np.arange(0, len(parts), LEAF)
        return (np.add.reduceat(np.fromiter(map(len, parts), np.int64, len(parts)), at),
                np.add.reduceat(np.fromiter(map(self.count, parts), np.int64, len(parts)), at), len(parts))


class Tree:
    """Segment tree over leaves (characters, tokens): node i has children 2i and 2i + 1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.size = 1 << max(0, (len(chars) - 1).bit_length())
        self.n = len(chars)
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size:self.size + self.n, 0] = chars
        self.sums[self.size:self.size + self.n, 1] = tokens
        level = self.size
        while level > 1:
            below = self.sums[level:2 * level]
            self.sums[level // 2:level] = below[0::2] + below[1::2]
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character ``place``."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            left = int(self.sums[node, 0])
            if place >= start + left:
                start += left
                node += 1
        return min(node - self.size, self.n - 1), start

    def set(self, first: int, leaves: list[tuple[int, int]]) -> None:
        nodes = set()
        for i, pair in enumerate(leaves):
            self.sums[self.size + first + i] = pair
            nodes.add((self.size + first + i) // 2)
        while nodes and 0 not in nodes:
            for node in nodes:
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            nodes = {node // 2 for node in nodes}


def edit(counter: Counter, text: str, tree: Tree, at: int, drop: int, put: str) -> tuple[str, Tree, int]:
    """(new text, tree, pre-tokens re-encoded) after one edit."""
    at = max(0, min(at, len(text)))
    drop = max(0, min(drop, len(text) - at))
    if not drop and not put:
        return text, tree, 0
    new = text[:at] + put + text[at + drop:]
    leaf, start = tree.leaf_at(max(0, at - AHEAD))
    if start > max(0, at - AHEAD):  # the place is the end of the text
        start -= int(tree.sums[tree.size + leaf, 0])
    while leaf > 0 and start > max(0, at - AHEAD):
        leaf -= 1
        start -= int(tree.sums[tree.size + leaf, 0])
    # old leaf borders behind the edit, in the new text's places
    shift = len(put) - drop
    last, border = leaf, start + int(tree.sums[tree.size + leaf, 0])
    while border < at + drop and last < tree.n - 1:
        last += 1
        border += int(tree.sums[tree.size + last, 0])
    made: list[tuple[int, int]] = []
    place = start
    for m in counter.find.finditer(new, start):
        piece = m.group()
        place = m.end()
        made.append((len(piece), counter.count(piece)))
        while last < tree.n - 1 and place > border + shift:
            last += 1
            border += int(tree.sums[tree.size + last, 0])
        if place == border + shift and place >= at + len(put) and last < tree.n - 1:
            break
    else:
        last = tree.n - 1
    room = last - leaf + 1
    if len(made) > 4 * LEAF * room:  # too full: the leaves are dealt anew from known sums
        cut = [made[i:i + LEAF] for i in range(0, len(made), LEAF)]
        sums = np.array([np.sum(c, axis=0) for c in cut], np.int64)
        old = tree.sums[tree.size:tree.size + tree.n]
        fresh = np.concatenate([old[:leaf], sums, old[last + 1:]])
        return new, Tree(fresh[:, 0], fresh[:, 1]), len(made)
    step = -(-len(made) // room) if made else 1
    tree.set(leaf, [tuple(np.sum(made[i * step:(i + 1) * step], axis=0, dtype=np.int64))
                    if made[i * step:(i + 1) * step] else (0, 0) for i in range(room)])
    return new, tree, len(made)


def recount(docs: DataFrame, edits: Column, key: str = "doc_id", text: str = "text",
            vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: key, n_pieces, n_tokens before the edits, n_after, n_encoded (the
    pre-tokens that the edits re-encoded) and the tree after them (node sums: characters, tokens).
    ``edits`` is an array of structs (at int, drop int, put string), places in characters."""
    ranks = ranks_of(vocabulary)
    d = docs.select(col(key).alias("key"), col(text).cast("string").alias("text"),
                    edits.cast("array<struct<at:bigint,drop:bigint,put:string>>").alias("edits"))

    def run(batches):
        counter = Counter(ranks)
        for b in parts(batches):
            rows = []
            for t, es in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = t or ""
                chars, tokens, pieces = counter.leaves(t)
                tree, encoded = Tree(chars, tokens), 0
                before = tree.tokens
                for e in es or ():
                    e = e or {}
                    t, tree, n = edit(counter, t, tree, e.get("at") or 0, e.get("drop") or 0, e.get("put") or "")
                    encoded += n
                rows.append((pieces, before, tree.tokens, encoded, tree.sums.astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0)] + [pa.array(x, kind) for x, kind in zip(
                    zip(*rows) if rows else [()] * 5, [pa.int64()] * 4 + [pa.binary()])],
                ["key", "n_pieces", "n_tokens", "n_after", "n_encoded", "tree"])

    kind = d.schema["key"].dataType.simpleString()
    return d.mapInArrow(
        run, f"key {kind}, n_pieces long, n_tokens long, n_after long, n_encoded long, tree binary")
