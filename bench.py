"""Benchmark: headline catalog queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is planned and executed to a no-op sink (the full result is
computed, nothing is collected to the driver).  One untimed warm-up query
runs first on the smallest scale factor (JVM start, code generation, Python
workers).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "label_distance_quality",   # dense centroids, z / percentile, nearest label (flagship)
    "dedupe_label_text",        # enrich bridge with three dims, keep-first, normalise, dedupe
    "text_purity",              # duplicate-text purity
    "tfidf_items",              # tokenise, 1-2 grams, df pruning, sublinear tf-idf, L2
    "top_ngrams_by_group",      # group-concatenated tf-idf, top-7 per group
    "nearest_centroid_sparse",  # sparse centroids + nearest label (broadcast kernel)
    "outlier_flags",            # both measures, z-scores, flags
    "label_distance_summary",   # per-label summary with exact p95
    "silhouette_rows",          # all-pairs silhouette (blocked kernel)
    "knn_neighbors",            # cosine 3-NN across folds (blocked kernel)
    "knn_predict",              # per-fold tf-idf (train-only vocabulary) + sparse 3-NN + vote
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("labelscope-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(int(cpus) * 2))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from labelscope.session import checkpoint_dir
    checkpoint_dir(spark)
    from labelscope.plans.catalog import QUERIES

    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        QUERIES["label_distance_quality"](spark, warm).write.format("noop").mode("overwrite").save()

    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
