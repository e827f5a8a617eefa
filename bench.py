"""Benchmark of the headline queries: one JSON line with seconds per query.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.spark_queries import QUERIES  # noqa: E402
from embedlens.session import local_session  # noqa: E402

HEADLINE = [
    # primitives with a published starting number
    "j1_near_pairs", "j3_knn_exact", "a12_dim_stats", "a2_text_dups", "w1_overlap",
    # one query per report
    "f4_orphan_class", "r1_health_collections", "r3_duplicates", "r4_cluster_metrics", "a20_storage", "r7_staleness",
    "j2_contradictions", "r9_anomalies", "r10_histogram", "r11_chunk_issues", "r12_distance_health", "m11_pca",
    # other operators
    "j5_neighbors", "j6_search", "j12_radius_pairs", "a3_components", "a8_percentiles", "a15_silhouette", "a17_density",
    "a22_max_similarity", "m1_kmeans_k3_i3", "w2_dead_zones", "w4_ordinals", "s7_export_vectors",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["j1_near_pairs"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the Python workers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
