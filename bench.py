"""Time the headline queries: one JSON line.

Each query is written to the no-op sink, so every row and column is computed.
One untimed pass starts the Python workers; the best of two is reported.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from tidemark.plans.catalog import QUERIES
from tidemark.session import get_spark

HEADLINE = (
    "semantic_search_topk",
    "batch_search_topk",
    "text_search",
    "score_bands",
    "l2_normalize",
    "normalize_text",
    "ingest_documents",
    "document_stats",
    "chunk_documents",
    "chunk_stats",
    "embed_chunks",
    "point_id",
    "html_extract",
    "scan_md",
    "mixed_sources",
    "linearize_md_tables",
    "upsert_documents",
    "replace_chunks",
    "delete_document",
    "index_status",
    "stored_index",
)


def run(name: str, spark, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    run("semantic_search_topk", spark, folder)
    run("chunk_documents", spark, folder)
    times = {n: round(min(run(n, spark, folder) for _ in range(2)), 3) for n in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
