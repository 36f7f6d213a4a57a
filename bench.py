"""Seconds of the headline queries, as one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores.  A query runs once to warm
up and then twice; the smaller time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINES = (
    "file_checksum", "stratum_histogram", "stratum_moments", "chi_square", "classify_chunks", "cdc_chunks", "cdc_chunks_default", "chunk_store", "path_choice", "duplicate_files",
    "known_chunks", "near_duplicates", "near_duplicates_corpus", "pair_correlation", "quantize_bytes", "dictionary_sample", "round_trip_zstd", "round_trip_lz4", "round_trip_delta",
    "compress_stats", "restore_pages_default", "certificate_ids",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from strata.plans import catalogue
    from strata.spark import local_session

    spark = local_session(cpus, "16g", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        times = []
        for _ in range(3):
            began = time.time()
            catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
            spark.catalog.clearCache()
        took[name] = round(min(times[1:]), 3)
    print(json.dumps({"metric": "seconds of all headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
