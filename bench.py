"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs to the end: its whole result goes to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from corpusflow.session import local_session

HEADLINE = [
    "interpret_corpus",
    "chunk_tokens",
    "chunk_text",
    "chunk_sections",
    "clean_layout",
    "token_estimate",
    "chunked_generate",
    "rolling_summary",
    "generate_cached",
    "cache_lookup",
    "lru_evict",
    "job_state",
    "batch_report",
    "error_stats",
    "rate_window",
    "span_pairs",
    "sse_chat",
    "extract_answer",
    "report_front_matter",
    "stream_job_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    from corpusflow.plans.catalogue import QUERIES

    names = sys.argv[1:] or HEADLINE
    QUERIES["files_by_kind"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the executors
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    result = {
        "metric": "headline_total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "documents_per_second": {
            n: round(documents / seconds[n], 1)
            for n in ("interpret_corpus", "chunk_tokens", "clean_layout")
            if seconds.get(n)
        },
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
