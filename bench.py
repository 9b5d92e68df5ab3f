"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftmark.plans.queries import QUERIES  # noqa: E402
from siftmark.session import local_session  # noqa: E402

HEADLINE = (
    "score_documents",
    "score_drop_rules",
    "influence_flatten",
    "ewma_weights",
    "collaborative_weights",
    "full_iteration",
    "topn_threshold",
    "select_lines",
    "cluster_sample_10",
    "cluster_sample_by_size_events",
    "batch_requests",
    "parse_responses",
    "class_report",
    "topk_accuracy",
    "match_influence",
    "match_multi_ckpt",
    "chunk_overlap",
    "prompt_mask",
    "pack_blocks",
    "random_sample",
    "weighted_mixture",
    "template_race",
    "template_tydiqa",
    "gradient_matching",
    "unigram_influence",
)


#: The table that a query reads most of, where it is not the documents.
READS = {
    "influence_flatten": "events", "ewma_weights": "events", "collaborative_weights": "events",
    "cluster_sample_by_size_events": "events", "class_report": "embeddings", "topk_accuracy": "embeddings",
    "match_influence": "embeddings", "match_multi_ckpt": "embeddings", "gradient_matching": "embeddings",
    "prompt_mask": "conversations",
}


def input_rows(spark, folder, names) -> dict[str, int]:
    counts = {}
    for name in names:
        table = READS.get(name, "documents")
        if table not in counts:
            counts[table] = spark.read.parquet(f"{folder}/{table}.parquet").count()
    return {name: counts[READS.get(name, "documents")] for name in names}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    QUERIES["score_documents"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
                "documents": documents,
                "rows_per_sec": {
                    name: round(rows / seconds[name]) for name, rows in input_rows(spark, folder, seconds).items()
                },
                "cores": os.environ.get("BENCH_CPUS", "8"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
