"""Benchmark: the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Stages run in stage order in one session (prepare -> TF-IDF -> statistics -> keywords
-> metrics -> prediction -> training); each time is the stage's own work, every result is
fully computed (noop sink). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    # name in output, registered query
    ("prepare_split", "w3_stratified_split"),
    ("tfidf_train", "f8_tfidf_weights"),
    ("tfidf_val", "m8_tfidf_transform_val"),
    ("profile_counts", "a1_value_counts"),
    ("term_statistics", "a13_term_statistics"),
    ("keywords", "m10_keywords"),
    ("evaluation", "m9_evaluation"),
    ("class_report", "a15_class_report"),
    ("classify_top3", "k4_top3"),
    ("masked_prediction", "m5_masked_prediction"),
    ("feature_table", "s5_feature_store"),
    # both levels each
    ("train_logreg_tfidf", "m3_logreg_tfidf"),
    ("train_svc_tfidf", "m4_svc_tfidf"),
    ("train_boosting", "m2_boosting"),
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tiercat.plans import fixtures as fx
    from tiercat.plans.registry import queries
    from tiercat.session import get_session

    spark = get_session(f"local[{cpus}]", int(cpus) * 2, app_name="tiercat-bench")
    qs = queries()
    # session warm-up (JVM start, code generation), not part of any query
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for out_name, qname in HEADLINE:
        if qname not in qs:
            continue
        t0 = time.time()
        qs[qname](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[out_name] = round(time.time() - t0, 3)
        print(out_name, times[out_name], file=sys.stderr, flush=True)
    fx.reset_memo()
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float((re.search(r"sf([0-9.]+)", sf_dir) or [0, "0"])[1].rstrip(".")),
    }))


if __name__ == "__main__":
    main()
