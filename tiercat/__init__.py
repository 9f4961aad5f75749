"""tiercat: hierarchical short-text categorization as Spark DataFrame and Spark ML jobs.

Layout:
  sources/    scans and sinks (CSV with null tokens, parquet, JSON keyword sink, model store)
  functions/  column expressions (text normalisation, tokens, n-grams, array argmax/top-k/masks)
  operators/  DataFrame -> DataFrame operators (profile, prepare, split, tfidf, features,
              train, predict, metrics, keywords)
  plans/      fixture views and the query registry
  streaming/  the batch scoring model applied to a streaming DataFrame
"""

from tiercat.session import get_session, checkpoint_dir  # noqa: F401
