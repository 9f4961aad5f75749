"""Sums of numeric blocks that tasks hand on as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(),
         "array<double>": pa.list_(pa.float64())}


def added_up(parts: DataFrame, finish: Callable, schema: str, single: bool = False) -> DataFrame:
    """Rows (block int, sums binary of doubles, or of single precision) added up in doubles by block, then
    ``finish(block, sums)``, a list of rows of ``schema``. Rows of a block stream through one task that holds the block's sum only."""
    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(raw, np.float32).astype(np.float64) if single else np.frombuffer(raw)
                total[k] = total[k] + v if k in total else v
        rows = [r for k, v in total.items() for r in finish(k, v)]
        names, kinds = zip(*(c.split() for c in schema.split(", ")))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(zip(*rows), kinds)], list(names))

    return parts.repartition("block").mapInArrow(run, schema)
