"""Times the headline queries once each, warm, and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tremolo.plans import catalog
from tremolo.session import local_session

HEADLINE = [
    "signal_stats", "compare_changes", "changed_features", "count_windows", "bucket_minmax", "sampling_rate_inference", "dft_spectrum", "band_energy", "local_maxima_prominence", "harmonic_nearest_match", "family_rank_margin",
    "diagnosis_batch", "clause_checks", "alignment_rerank", "bm25_topk", "cosine_topk", "hybrid_topk", "chunks", "history_window", "session_list",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, partitions=cpus)
    queries = catalog.queries()
    queries["signal_stats"](spark, sf).write.format("noop").mode("overwrite").save()  # the first query also pays for the JVM's start
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
