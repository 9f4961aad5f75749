"""End-to-end API: fit both levels, then score batches (or streams) of texts.

``HierarchicalClassifier`` is the Spark form of the reference's inference object: two
Spark ML models, the two label dictionaries and the category map, all three tables; ``transform`` scores a
DataFrame of texts (M6/M7) with no per-row Python.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tiercat.operators import features as fe
from tiercat.operators import predict as pd_
from tiercat.operators import prepare as prep
from tiercat.operators import train as tr
from tiercat.session import materialize
from tiercat.sources.io import write_parquet


@dataclass
class HierarchicalClassifier:
    cat_model: PipelineModel
    sub_model: PipelineModel
    categories: DataFrame       # (category, category_id)
    subcategories: DataFrame    # (sub_category, subcategory_id)
    cmap: DataFrame
    dim: int = fe.TEXT_DIM

    @classmethod
    def fit(cls, prepared: DataFrame, categories: DataFrame, subcategories: DataFrame,
            family: str = "logreg", dim: int = fe.TEXT_DIM, max_iter: int | None = None,
            text: str = prep.TEXT, type_col: str = prep.TYPE,
            cmap: DataFrame | None = None) -> "HierarchicalClassifier":
        """Train both levels on the rows of ``prepared`` (already split: pass the train
        rows). ``cmap`` is the category map of all rows, before the split, so that a pair
        seen only in validation can be predicted; without it the given rows make the map."""
        d = tr.dense_vectors(fe.dense_features(prepared, text, type_col,
                                               fe.HashingEncoder(dim)), "features")
        d = d.select("features", prep.CATEGORY_ID, prep.SUBCATEGORY_ID).cache()
        cat = tr.fit(d, family, prep.CATEGORY_ID, max_iter=max_iter, dense=True)
        sub = tr.fit(d, family, prep.SUBCATEGORY_ID, max_iter=max_iter, dense=True)
        d.unpersist()
        tables = {"categories": categories, "subcategories": subcategories,
                  "category-map": prep.category_map(prepared) if cmap is None else cmap}
        return cls(cat, sub, *[materialize(prepared.sparkSession, t, n) for n, t in tables.items()], dim)

    def transform(self, df: DataFrame, text: str = prep.TEXT, type_col: str = prep.TYPE,
                  top_k: int | None = None) -> DataFrame:
        """M6/M7: adds category, subcategory, both confidences (and top-k lists)."""
        d = tr.dense_vectors(fe.dense_features(df, text, type_col,
                                               fe.HashingEncoder(self.dim)), "features")
        s = tr.probabilities(self.cat_model, d, "cat_prob").drop("prediction")
        s = tr.probabilities(self.sub_model, s, "sub_prob").drop("prediction", "features")
        return pd_.classify(s, self.cmap, self.categories, self.subcategories, k=top_k)

    def save(self, path: str) -> None:
        """S6 + S7: models by Spark ML persistence, map and dictionaries as parquet."""
        tr.save(self.cat_model, os.path.join(path, "category_model"))
        tr.save(self.sub_model, os.path.join(path, "subcategory_model"))
        write_parquet(self.cmap, os.path.join(path, "category_map"))
        write_parquet(self.categories, os.path.join(path, "categories"))
        write_parquet(self.subcategories, os.path.join(path, "subcategories"))
        size = self.cmap.sparkSession.createDataFrame([(self.dim,)], "dim int")
        write_parquet(size, os.path.join(path, "settings"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "HierarchicalClassifier":
        return cls(tr.load(os.path.join(path, "category_model")),
                   tr.load(os.path.join(path, "subcategory_model")),
                   *[spark.read.parquet(os.path.join(path, t))
                     for t in ("categories", "subcategories", "category_map")],
                   spark.read.parquet(os.path.join(path, "settings")).first()["dim"])
