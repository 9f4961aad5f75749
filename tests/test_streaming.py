"""The batch scoring plan runs unchanged on a streaming source."""

import os

from tiercat.plans import fixtures as fx
from tiercat.plans.classifier import HierarchicalClassifier
from tiercat.streaming.scoring import score_stream

from folders import SF_SMALL


def test_stream_scoring_matches_batch(spark, tmp_path):
    p = fx.prepare(fx.txn(spark, SF_SMALL), 2)
    model = HierarchicalClassifier.fit(p.split("train"), p.categories, p.subcategories,
                                       "logreg", max_iter=10)
    src = str(tmp_path / "in")
    batch = p.split("val").select("doc_id", "clean_description", "type")
    batch.write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = (score_stream(model, stream).select("doc_id", "subcategory")
         .writeStream.format("memory").queryName("scored").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = {r.doc_id: r.subcategory for r in spark.sql("SELECT * FROM scored").collect()}
    want = {r.doc_id: r.subcategory for r in model.transform(batch).collect()}
    assert got == want
