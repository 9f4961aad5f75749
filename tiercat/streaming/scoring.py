"""Batch scoring applied to a stream.

The reference has no streaming operator. Every step of :class:`HierarchicalClassifier`
``transform`` is stateless (projection, stream-static joins with the category map
and the label dictionaries, model scoring), so the same plan scores a ``readStream`` source micro-batch by
micro-batch; nothing here keeps state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tiercat.plans.classifier import HierarchicalClassifier


def score_stream(model: HierarchicalClassifier, stream: DataFrame, text: str = "clean_description",
                 type_col: str = "type") -> DataFrame:
    """Streaming DataFrame of texts -> streaming DataFrame of predictions."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame (spark.readStream...)")
    return model.transform(stream, text, type_col)
