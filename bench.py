"""Wall seconds of the headline queries, as one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from newsflow.plans import load_queries
from newsflow.session import build_session

HEADLINE = (
    "rated_sections", "dedup_exact_best", "recency_rating", "section_order", "dense_numbering", "log_stats",
    "redact_secrets", "topic_frequency", "html_links", "html_text", "seen_url_since", "title_domain_antijoin",
    "upsert_latest", "apply_edits", "model_column", "summary_extract", "cosine_pairs", "neardup_drop", "mmr_topk",
    "cluster_metrics", "battle_pairs", "bradley_terry", "neardup_documents", "stream_unseen", "cluster_density", "cluster_validity", "cluster_search",
    "tournament",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_queries()[0]
    names = sys.argv[1:] or HEADLINE
    # One query before the clock: the engine, the Python workers and the shared folder are ready then.
    queries["html_text"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(found.group(1)) if found else None,
    }))


if __name__ == "__main__":
    main()
