"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tiercat.session import scratch_path

# A word of the contracts: a maximal run of bytes that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """A column by its exact name, also if the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column (case does not tell columns apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back. The plan runs
    once, lineage is cut, and a lost executor's share is read again from files."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: str, modulus: int = 5) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def body(text: str) -> Column:
    return F.coalesce(col(text), F.lit(""))


def words_in(text: str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.regexp_count(body(text), F.lit(WORD)).cast("long")


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into rows of about ``size`` bytes, so a task holds few texts as objects."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def lower_words(raw: bytes) -> list[bytes]:
    """Words after lower-casing A-Z: bytes.lower and bytes.split know ASCII only, and the
    white space that split knows is exactly 0x20 and 0x09-0x0D."""
    return raw.lower().split()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches of a partition sorted by ``key`` (not null): the
    last group of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = batch.column(batch.schema.get_field_index(key))
        last = keys[len(keys) - 1]
        if held[0].column(batch.schema.get_field_index(key))[0] == last:
            continue
        table = pa.Table.from_batches(held)
        end = table.num_rows
        values = table.column(key).to_numpy()
        start = int(values.searchsorted(values[-1]))
        yield table.slice(0, start).combine_chunks()
        held = table.slice(start, end - start).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def ranked(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``start`` (the place of the group's first row in the order of all rows), ``at``
    (the row's place in its group, from 0) and ``size`` (rows of the group), a null group first.

    Rows are dealt by ranges of (group, order) and sorted inside the ranges; only one row for each
    group and range is summed up further, so a group that holds most rows is never sorted in one
    task. ``order`` should tell rows apart, or equal rows stay in one range."""
    keys = [col(group).asc_nulls_first(), *order]
    s = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
               .withColumn("id", F.monotonically_increasing_id()), name)
    s = s.withColumn("part", F.shiftright("id", 33))
    parts = s.groupBy(group, "part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # one row a range: as many as there are partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = parts.groupBy("part").agg(F.sum("n").alias("rows")).select(
        "part", (F.coalesce(F.sum("rows").over(before), F.lit(0))
                 - F.shiftleft(F.col("part"), 33)).alias("shift"))
    whole = Window.partitionBy(group)
    parts = (parts.join(ranges, "part").withColumn("start", F.min(F.col("first") + F.col("shift")).over(whole))
             .withColumn("size", F.sum("n").over(whole)))
    p = parts.select(col(group).alias("p_group"), F.col("part").alias("p_part"), "start", "size", "shift")
    same = (F.col("part") == F.col("p_part")) & col(group).eqNullSafe(F.col("p_group"))
    return s.join(p, same).withColumn("at", F.col("id") + F.col("shift") - F.col("start")) \
        .drop("id", "part", "p_group", "p_part", "shift")
