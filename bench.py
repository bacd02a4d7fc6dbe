"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from textlab.plans import registry

HEADLINE = (
    "clean_page_text",
    "normalize_corpus",
    "normalize_eval",
    "explode_answers",
    "corpus_stats",
    "dense_ids",
    "stratified_split",
    "undersample",
    "scaling_samples",
    "scenarios",
    "knn_broadcast",
    "knn_block",
    "knn_self_excluded",
    "knn_vote",
    "rag_prompts",
    "training_records",
    "balanced_records",
    "metrics_by_source",
    "metrics_by_split",
    "evaluate_predictor",
    "hash_embed",
    "embed_resume",
    "stream_normalized",
    "stream_scored",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("textlab-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the Python workers' machinery before anything is timed.
    registry.QUERIES["knn_vote"](spark, folder).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
