"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from reviewloom.plans import catalog
from reviewloom.session import local_session

HEADLINE = (
    "clean_reviews label_distribution sample_exact_n search_corpus index_build search_topk search_batch_topk "
    "search_pruned search_text_tfidf search_snippets search_free_text keyword_counts summary_with_evidence "
    "topic_names topic_chart themes_density themes_kmeans split_80_10_10 token_window metrics_binary "
    "sentiment_train_eval sentiment_score dashboard_stats"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "reviewloom-bench")
    queries = catalog.registered()
    queries["label_distribution"](spark, sf_dir).collect()  # start the workers
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
