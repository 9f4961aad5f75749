"""M1: text vectors learned from the corpus, by a randomised truncated SVD of the stored TF-IDF rows.

A random block of ``DIM`` + ``OVER`` directions over the terms is multiplied by the rows and their transpose
(one pass each time, sums by blocks of terms) and made orthonormal, ``POWER`` + 1 times: it turns towards the
leading right singular vectors. A last pass gives the rows' small Gram matrix in these directions, whose
eigenvectors are the singular vectors there. A text's vector is its row times them, of length 1.

  * Passes add sums by term block (``blocks.added_up``), handed on block by block in single precision. The number of
    tasks is bounded by the sums they hand on (``PASS_BYTES``), so a pass's traffic does not grow with the rows.
    Orthonormalisation multiplies each block by a small matrix told by the blocks' summed Gram matrix, twice for
    accuracy. The driver solves eigenproblems of DIM + OVER columns only.
  * A task works on slices of rows in single precision: terms of many rows as a dense block, others row by row
    (:class:`Product`). With ``idf`` rows hold counts in place of weights (:meth:`tfidf.TfidfModel.sparse_of`).
  * Tasks get the directions as one broadcast of size x (DIM + OVER) x 4 bytes, checked against ``max_bytes``
    before anything runs: 320 MB at the reference's cap of 200,000 terms.

A text without any term of the vocabulary has the zero vector; with fewer terms than directions the vectors
are filled up with zeros.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tiercat.operators.blocks import added_up
from tiercat.operators.features import TEXT_DIM
from tiercat.operators.tfidf import weighed
from tiercat.session import materialize

OVER, POWER, BLOCK = 16, 2, 4096
SLICE_ROWS, DENSE, DENSE_TERMS = 512, .03, 4096  # rows worked on at once; share of rows that makes a term dense; at most
MAX_BYTES = 1 << 30
PASS_BYTES = 4 << 30  # of sums that the tasks of a pass hand on together, about


def most_tasks(size: int, wide: int, cores: int) -> int:
    """Tasks of a pass at most, whatever the number of rows: a task hands on its whole sums, so more tasks than this
    would make a pass's traffic grow with rows x terms x directions. One a core always."""
    return max(cores, PASS_BYTES // max(size * wide * 4, 1))


@dataclass
class LearnedEncoder:
    """``blocks``: (block, weights), doubles by term and direction; ``values``: the singular values."""
    blocks: DataFrame
    size: int
    dim: int
    values: list[float]

    def matrix(self) -> np.ndarray:
        return _whole(self.blocks, self.size)

    def encode(self, rows: DataFrame, out: str = "text_vec", idf: np.ndarray | None = None) -> DataFrame:
        """``rows`` (``indices``, ``values``, ...; or ``indices``, ``tf``, ``norm``, ... with ``idf``) with the vectors
        ``out`` in their place."""
        payload = _payload(idf)
        rest = [c for c in rows.columns if c not in payload]
        schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
        sent, dim = rows.sparkSession.sparkContext.broadcast((self.matrix(), idf)), self.dim

        def run(batches):
            basis, known = sent.value
            p = Product(basis)
            for b in batches:
                v = np.zeros((b.num_rows, dim), np.float32)
                for a, part in _parts(b, known):
                    y = p.times(*part)[0]
                    n = np.sqrt(np.square(y, dtype=np.float64).sum(axis=1, keepdims=True))
                    v[a:a + len(y), :y.shape[1]] = np.divide(y, n, out=np.zeros_like(y, np.float64), where=n > 0)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[len(payload):], pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dim).cast(pa.list_(pa.float32()))],
                    [*rest, out])

        return rows.select(*payload, *[F.col(f"`{c}`") for c in rest]).mapInArrow(
            run, ", ".join(x for x in (schema, f"{out} array<float>") if x))

    def save(self, path: str) -> None:
        """The blocks as parquet, the settings as one JSON line."""
        self.blocks.write.mode("overwrite").parquet(os.path.join(path, "blocks"))
        meta = json.dumps({"size": self.size, "dim": self.dim, "values": self.values})
        self.blocks.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1) \
            .write.mode("overwrite").text(os.path.join(path, "settings"))


def load(spark: SparkSession, path: str) -> LearnedEncoder:
    meta = json.loads(spark.read.text(os.path.join(path, "settings")).first()[0])
    return LearnedEncoder(spark.read.parquet(os.path.join(path, "blocks")), **meta)


def _payload(idf) -> list[str]:
    return ["indices", "values"] if idf is None else ["indices", "tf", "norm"]


def _parts(batch: pa.RecordBatch, idf: np.ndarray | None):
    """(first row, (ends, terms, values)) of slices of a batch, from its first columns."""
    if idf is None:
        at, x = batch.column(0), batch.column(1)
        ends, begin = at.offsets.to_numpy(), x.offsets.to_numpy()
        terms, values = (c.values.to_numpy()[o[0]:o[-1]] if len(at) else np.zeros(0, int) for c, o in ((at, ends), (x, begin)))
        ends = ends - ends[0] if len(at) else ends
    else:
        (ends, terms), _, values = weighed(batch, 0, idf)
    for a in range(0, batch.num_rows, SLICE_ROWS):
        e = ends[a:min(a + SLICE_ROWS, batch.num_rows) + 1]
        yield a, (e - e[0], terms[e[0]:e[-1]], values[e[0]:e[-1]].astype(np.float32))


class Product:
    """Products of sparse rows with a matrix ``d`` (term x direction) in single precision, and sums of rows' transposes
    times such products. Which terms are dense is told by the first slice; others would only take longer."""

    def __init__(self, d: np.ndarray):
        self.d, self.head, self.sums = d, None, None
        self.one = self.two = np.empty((0, d.shape[1]), np.float32)

    def times(self, ends: np.ndarray, terms: np.ndarray, x: np.ndarray):
        """The rows' products, and what :meth:`add` needs."""
        d, n = self.d, len(ends) - 1
        if self.head is None:
            seen = np.bincount(terms, minlength=len(d))
            self.head = np.flatnonzero(seen > DENSE * n)
            self.head = self.head[np.argsort(-seen[self.head], kind="stable")[:DENSE_TERMS]]
            self.place = np.full(len(d), -1, np.int32)
            self.place[self.head] = np.arange(len(self.head))
            self.dense = d[self.head]
        row, at = np.repeat(np.arange(n), np.diff(ends)), self.place[terms]
        some = at >= 0
        block = np.zeros((n, len(self.head)), np.float32)
        block[row[some], at[some]] = x[some]
        y = block @ self.dense
        terms, x, row = terms[~some], x[~some], row[~some]
        e = np.searchsorted(row, np.arange(n + 1))
        most = int(np.diff(e).max(initial=0))
        if most > len(self.one):
            self.one, self.two = (np.empty((most, d.shape[1]), np.float32) for _ in range(2))
        for i in np.flatnonzero(np.diff(e)).tolist():
            a, b = e[i], e[i + 1]
            y[i] += x[a:b] @ d.take(terms[a:b], axis=0, out=self.one[:b - a], mode="clip")
        return y, (block, e, terms, x)

    def add(self, y: np.ndarray, rest) -> None:
        """Adds the rows' transpose times ``y``."""
        if self.sums is None:
            self.sums, self.dense_sums = np.zeros(self.d.shape, np.float32), np.zeros(self.dense.shape, np.float32)
        block, e, terms, x = rest
        self.dense_sums += block.T @ y
        for i in np.flatnonzero(np.diff(e)).tolist():
            a, b = e[i], e[i + 1]
            new = np.multiply(x[a:b, None], y[i], out=self.one[:b - a])
            new += self.sums.take(terms[a:b], axis=0, out=self.two[:b - a], mode="clip")
            self.sums[terms[a:b]] = new

    def total(self) -> np.ndarray:
        if self.sums is None:
            return np.zeros(self.d.shape, np.float32)
        self.sums[self.head] += self.dense_sums
        self.dense_sums[:] = 0
        return self.sums


def _whole(blocks: DataFrame, size: int) -> np.ndarray:
    """All blocks as one float32 matrix; the next part of the table is fetched meanwhile."""
    out, kind = None, np.float64
    if "single" in blocks.columns:
        blocks, kind = blocks.select("block", "single"), np.float32
    for block, raw in blocks.toLocalIterator(prefetchPartitions=True):
        terms = min(BLOCK, size - block * BLOCK)
        w = np.frombuffer(raw, kind).reshape(terms, -1)
        if out is None:
            out = np.zeros((size, w.shape[1]), np.float32)
        out[block * BLOCK:block * BLOCK + terms] = w
    return np.zeros((size, 0), np.float32) if out is None else out


def _multiplied(blocks: DataFrame, by: list[np.ndarray], single: bool = False) -> DataFrame:
    """The blocks times small matrices, one after the other; ``single``: in single precision besides."""
    def run(batches):
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = np.frombuffer(x).reshape(-1, len(by[0]))
                for m in by:
                    w = w @ m
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
                                                  for v in (w, *([w.astype(np.float32)] if single else [])))],
                    ["block", "weights", "single"][:2 + single])

    return blocks.select("block", "weights").mapInArrow(run, "block int, weights binary" + ", single binary" * single)


def _gram(blocks: DataFrame, wide: int) -> np.ndarray:
    def run(batches):
        total = np.zeros((wide, wide))
        for b in batches:
            for x in b.column(1).to_pylist():
                w = np.frombuffer(x).reshape(-1, wide)
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()])], ["block", "sums"])

    got = added_up(blocks.mapInArrow(run, "block int, sums binary"), lambda k, v: [(k, v.tobytes())],
                   "block int, sums binary").first()
    return np.frombuffer(got["sums"]).reshape(wide, wide) if got else np.zeros((wide, wide))


def orthonormal(blocks: DataFrame, wide: int) -> tuple[DataFrame, int]:
    """Blocks whose columns span the same directions and are orthonormal, and their number. What is between the two
    rounds is not written."""
    by: list[np.ndarray] = []
    for _ in range(2):
        s, u = np.linalg.eigh(_gram(_multiplied(blocks, by) if by else blocks, wide))
        keep = s > max(s.max(initial=0.0), 0.0) * 1e-13
        by.append(u[:, keep] / np.sqrt(s[keep]))
        wide = int(keep.sum())
    return materialize(blocks.sparkSession, _multiplied(blocks, by, single=True), "directions"), wide


def fit(rows: DataFrame, size: int, dim: int = TEXT_DIM, seed: int = 42, max_bytes: int = MAX_BYTES,
        idf: np.ndarray | None = None) -> LearnedEncoder:
    """The leading ``dim`` right singular vectors of ``rows`` (``indices``, ``values``; or ``indices``, ``tf``, ``norm``
    with ``idf``) over ``size`` terms."""
    spark, wide = rows.sparkSession, min(dim + OVER, size)
    if size * wide * 4 > max_bytes:
        raise ValueError(f"{size} terms x {wide} directions exceed {max_bytes} bytes")
    rows = rows.select(*_payload(idf)).coalesce(most_tasks(size, wide, spark.sparkContext.defaultParallelism))
    q, rng = np.empty((size, wide), np.float32), np.random.default_rng(seed)
    for k in range(0, size, BLOCK):  # one array in doubles would be twice as large
        q[k:k + BLOCK] = rng.standard_normal((min(BLOCK, size - k), wide))

    def passed(gram: bool) -> DataFrame:
        """Sums over the rows: of x (x q) by term block, or of the rows' Gram matrix in the directions."""
        sent, n = spark.sparkContext.broadcast((q, idf)), q.shape[1]

        def run(batches):
            d, known = sent.value
            p, z = Product(d), np.zeros((n, n))
            for b in batches:
                for _, part in _parts(b, known):
                    y, rest = p.times(*part)
                    if gram:
                        y = y.astype(np.float64)
                        z += y.T @ y
                    else:
                        p.add(y, rest)
            z = z if gram else p.total()
            for k, w in [(0, z)] if gram else ((k // BLOCK, z[k:k + BLOCK]) for k in range(0, size, BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([w.tobytes()], pa.binary())],
                                                 ["block", "sums"])

        summed = materialize(spark, added_up(rows.mapInArrow(run, "block int, sums binary"), lambda k, v: [(k, v.tobytes())],
                                             "block int, weights binary", single=not gram), "svd-pass")
        sent.destroy()
        return summed

    blocks = None
    for _ in range(POWER + 1):
        blocks, wide = orthonormal(passed(False), wide)
        q = None  # the driver holds one copy
        q = _whole(blocks, size)
    got = passed(True).first() if wide else None
    s, u = np.linalg.eigh(np.frombuffer(got["weights"]).reshape(wide, wide) if got else np.zeros((wide, wide)))
    order = np.argsort(-s)[:dim]
    basis = materialize(spark, _multiplied(blocks, [u[:, order]]), "text-basis")
    return LearnedEncoder(basis, size, dim, np.sqrt(np.maximum(s[order], 0)).tolist())
