"""Exact top-k inner products by norm buckets with local pruning.

Vectors are ordered by length and cut into buckets of ``bucket_rows``; a bucket is one row
that holds its vectors as a matrix, so it travels and is read as a block. Every query gets a
first threshold, the k-th best product with the longest vectors of its dimension (a lower
bound of the k-th best of all). A block of queries meets a bucket only if its longest vector
could still reach the threshold of some query there. In the bucket the threshold becomes a
local cosine bound, and the cheaper of two cuts is taken per query: a prefix by length
(|p| >= threshold / |q|), or, where the local bound is high, the rows whose coordinate on
the query's largest entry lies in the range that the bound allows. The products of what is
left are computed exactly and ranked. Pairs arrive in order of buckets, and a task keeps the order of the
coordinates of the bucket at hand, so it is sorted once for all blocks that meet it there.

All queries against all rows is a stated query set against the table, in blocks: its work
grows with queries x rows at worst, its memory with the two block sizes.

Defined cases: vectors that are null or hold a null or non-finite entry, rows with a null id,
and empty vectors take no part; vectors meet only others of their dimension; repeated ids are
rows of their own, and a query meets every row but its own, also those that repeat its id; fewer than k
candidates are all returned; equal scores rank by smaller id; entries beyond 2^62 in amount count as 2^62, and
a product beyond the range of a long as the end of that range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tiercat.llm.common import col, stored


def quantised(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, dim, v array<long>, norm) with v = floor(scale * x), of the vectors that take part."""
    x = col(vector).cast("array<double>")
    limit = float(2 ** 62)
    d = vectors.select(col(key).cast("long").alias("id"), x.alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
        & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    v = F.transform("x", lambda e: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), F.lit(scale) * e))))
    d = d.select("id", F.size("x").alias("dim"), v.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    return d.withColumn("norm", F.sqrt(square))


def packed(rows: DataFrame, group: list[str]) -> DataFrame:
    """One row per group: ids, matrix (int64), norms and row numbers as bytes, longest first."""
    w = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("norm", "id", "v", "at")), False).alias("r"))
    schema = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in group)

    def run(batches):
        for b in batches:
            lists = b.column(len(group))
            for i in range(b.num_rows):
                r = lists[i].values
                ids = r.field("id").to_numpy(zero_copy_only=False)
                m = r.field("v").flatten().to_numpy(zero_copy_only=False)
                norms = r.field("norm").to_numpy(zero_copy_only=False)
                at = r.field("at").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [b.column(k).slice(i, 1) for k in range(len(group))]
                    + [pa.array([x.tobytes()]) for x in (ids, m, norms, at)],
                    [*group, "ids", "matrix", "norms", "ats"])

    return w.mapInArrow(run, f"{schema}, ids binary, matrix binary, norms binary, ats binary")


def _exact(m: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in the type whose products are exact: floating point while no sum can
    reach 2^53, 64-bit integers while none can reach 2^63, else integers of any length."""
    top = float(np.abs(m).max(initial=0)) * float(np.abs(q).max(initial=0)) * m.shape[1]
    kind = np.float64 if top < 2.0 ** 53 else np.int64 if top < 2.0 ** 62 else object
    return m.astype(kind), q.astype(kind)


def _long(s: np.ndarray) -> np.ndarray:
    """Products as 64-bit integers; what lies beyond is the end of the range."""
    return (np.clip(s, -2 ** 63, 2 ** 63 - 1) if s.dtype == object else s).astype(np.int64)


def _kept(norms: np.ndarray, by_entry: np.ndarray, sorted_entry: list[np.ndarray], q: np.ndarray,
          q_norm: float, least: float) -> np.ndarray:
    """Rows of a bucket that can reach the product ``least`` with q: by length or by coordinate."""
    n = len(norms)
    if least <= 0 or q_norm == 0:
        return np.arange(n)
    slack = 1 - 1e-9
    prefix = int(np.searchsorted(-norms, -(least / q_norm) * slack, side="right"))
    local = least / (q_norm * norms[0]) * slack if norms[0] else 2.0
    if local <= 0 or prefix == 0:
        return np.arange(prefix)
    if local >= 1:
        local = 1.0
    f = int(np.argmax(np.abs(q)))
    a = float(q[f]) / q_norm
    spread = np.sqrt(max(0.0, (1 - a * a) * (1 - local * local)))
    # a row at an angle of cosine >= local to q has its entry f in this range; beyond the
    # turning point the range is open to 1 (or -1)
    low = -1.0 if a < -local else a * local - spread
    high = 1.0 if a > local else a * local + spread
    i = int(np.searchsorted(sorted_entry[f], low - 1e-9, side="left"))
    j = int(np.searchsorted(sorted_entry[f], high + 1e-9, side="right"))
    if j - i < prefix:
        rows = by_entry[f][i:j]
        return rows[rows < prefix]
    return np.arange(prefix)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to smaller ids."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.nonzero(scores >= cut)[0]
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(rows, -1)


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
           k: int = 5, query_every: int = 50, bucket_rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``query_every``, the
    k other rows with the highest inner products of floor(scale * x)."""
    rows = quantised(vectors, key, vector, scale)
    order = ["dim", F.desc("norm"), "id"]
    rows = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("part", F.spark_partition_id())
                  .withColumn("at", F.monotonically_increasing_id()), "vectors")
    # buckets: runs of rows of one partition and dimension, in order of length
    firsts = rows.groupBy("dim", "part").agg(F.min("at").alias("first"))
    rows = rows.join(firsts, ["dim", "part"]).withColumn(
        "bucket", F.struct("dim", "part", F.floor((F.col("at") - F.col("first")) / bucket_rows).alias("no")))
    rows = rows.withColumn("bucket", F.concat_ws("/", "bucket.dim", "bucket.part", "bucket.no"))
    buckets = stored(packed(rows, ["dim", "bucket"]), "vector-buckets")
    heads = buckets.select("dim", "bucket", F.col("norms"))

    def longest(batches):
        for b in batches:
            top = [np.frombuffer(x, np.float64)[0] for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(top, pa.float64())],
                                             ["dim", "bucket", "longest"])

    sizes = stored(heads.mapInArrow(longest, "dim int, bucket string, longest double"), "bucket-lengths")
    queries = rows.where(F.col("id") % query_every == 0).withColumn(
        "block", F.concat_ws("/", "dim", F.pmod(F.xxhash64("id"), F.lit(1 << 40))
                             % F.lit(_blocks(rows, query_every, query_rows))))
    blocks = stored(packed(queries, ["dim", "block"]), "query-blocks")

    # first thresholds from the bucket with the longest vectors of each dimension
    w = Window.partitionBy("dim").orderBy(F.desc("longest"), "bucket")
    lead = sizes.withColumn("r", F.row_number().over(w)).where("r = 1").select("dim", "bucket")
    lead = buckets.join(lead, ["dim", "bucket"]).select(
        "dim", F.col("ats").alias("b_ats"), F.col("matrix").alias("b_matrix"))
    if sizes.select("dim").distinct().limit(17).count() < 17:  # as many buckets travel
        lead = F.broadcast(lead)

    def first(batches):
        for b in batches:
            for r in b.to_pylist():
                own, ats = np.frombuffer(r["ats"], np.int64), np.frombuffer(r["b_ats"], np.int64)
                m, q = _exact(_matrix(r["b_matrix"], len(ats)), _matrix(r["matrix"], len(own)))
                s = _long(m @ q.T).astype(np.float64)
                s[ats[:, None] == own[None, :]] = -np.inf
                least = np.partition(s, len(ats) - k, axis=0)[-k] if len(ats) >= k \
                    else np.full(len(own), -np.inf)
                norms = np.frombuffer(r["norms"], np.float64)
                need = np.where(least > 0, least / np.maximum(norms, 1e-300), -1.0)
                yield pa.RecordBatch.from_pylist([{
                    "dim": r["dim"], "block": r["block"], "q_ids": r["ids"], "q_matrix": r["matrix"],
                    "q_norms": r["norms"], "q_ats": r["ats"], "least": least.tobytes(), "need": float(need.min())}],
                    schema=pa.schema([("dim", pa.int32()), ("block", pa.string()), ("q_ids", pa.binary()),
                                      ("q_matrix", pa.binary()), ("q_norms", pa.binary()), ("q_ats", pa.binary()),
                                      ("least", pa.binary()), ("need", pa.float64())]))

    blocks = stored(blocks.join(lead, "dim").mapInArrow(
        first, "dim int, block string, q_ids binary, q_matrix binary, q_norms binary, q_ats binary, least binary, "
               "need double"),
        "query-thresholds")
    # a block of queries meets the buckets that can still reach one of its thresholds
    # (a dimension is one key, so blocks are salted and the narrow bucket list is repeated)
    salted = blocks.select("dim", "block", "need").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(16)))
    met = salted.join(sizes.withColumn("salt", F.explode(F.expr("sequence(0L, 15L)"))),
                      ["dim", "salt"]) \
        .where(F.col("longest") >= F.col("need") * (1 - 1e-9)).select("block", "bucket")
    pairs = met.join(blocks.drop("dim", "need"), "block").join(buckets, "bucket")

    def compare(batches):
        held, entry, ordered = None, None, None
        for b in batches:
            for at_row in range(b.num_rows):
                r = b.slice(at_row, 1).to_pylist()[0]
                ids, norms = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["norms"], np.float64)
                q_ids, q_norms = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_norms"], np.float64)
                least = np.frombuffer(r["least"], np.float64)
                m, q = _exact(_matrix(r["matrix"], len(ids)), _matrix(r["q_matrix"], len(q_ids)))
                if r["bucket"] != held:
                    unit = m.astype(np.float64) / np.maximum(norms, 1e-300)[:, None]
                    entry, held = np.argsort(unit, axis=0, kind="stable").T, r["bucket"]
                    ordered = [unit[e, f] for f, e in enumerate(entry)]
                ats, own = np.frombuffer(r["ats"], np.int64), np.frombuffer(r["q_ats"], np.int64)
                found = []
                for i in range(len(q_ids)):
                    at = _kept(norms, entry, ordered, q[i].astype(np.float64), q_norms[i], least[i])
                    at = at[ats[at] != own[i]]
                    s = _long(m[at] @ q[i])
                    good = s >= least[i]
                    at, s = at[good], s[good]
                    top = _best(ids[at], s, k)
                    found.append((np.full(len(top), i), np.full(len(top), q_ids[i]), ids[at[top]], s[top]))
                no, *rest = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"]] * len(no), pa.string()), pa.array(no, pa.int32()),
                     *map(pa.array, rest)], ["block", "no", "query_id", "vec_id", "score"])

    out = pairs.select("block", "bucket", "ids", "matrix", "norms", "ats", "q_ids", "q_matrix", "q_norms", "q_ats",
                       "least").mapInArrow(
        compare, "block string, no int, query_id long, vec_id long, score long")
    w = Window.partitionBy("block", "no").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _blocks(rows: DataFrame, query_every: int, query_rows: int) -> int:
    n = rows.where(F.col("id") % query_every == 0).count()
    return max(1, -(-n // query_rows))
