"""Runs headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quern.plans import catalogue
from quern.session import session

HEADLINE = [
    "clean_reason_counts", "clean_paragraphs", "quality_reasons", "exact_dedup", "near_dup_pairs", "near_dedup_ordered", "benchmark_contamination",
    "document_segments", "continuity_runs", "token_offsets", "packed_windows", "packing_statistics", "character_frequencies", "family_budget",
    "hash_rank_sample", "confusion_metrics", "threshold_sweep", "hamming_neighbours", "event_repetition", "shared_lines", "pii_counts", "pricing_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = session(f"local[{cpus}]", cpus, **{"spark.driver.memory": "12g"})
    catalogue.QUERIES["pricing_summary"](spark, sf_dir).count()  # starts the session's threads
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}), flush=True)


if __name__ == "__main__":
    main()
