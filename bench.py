"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from prosegauge.plans.catalog import QUERIES
from prosegauge.session import build_session

HEADLINE = [
    "abuse_report", "paragraph_split", "token_counts", "marker_scores", "writing_quality_doc", "constructiveness",
    "clean_corpus", "dedupe_first", "stratified_split", "rebalance", "heuristic_label", "writer_type",
    "paragraph_stance", "conversation_stance", "player_match", "last_n_stat", "this_season_stat", "verify_documents",
    "quota_decisions", "running_average", "writer_profiles", "like_minded_writers", "membership_replay",
    "band_report", "score_histogram", "label_centroids", "knn_votes", "score_documents_job",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["class_distribution"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
