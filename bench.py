"""Times the headline queries: median of three runs each, printed as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from spanloom.plans.queries import all_queries
from spanloom.session import build_session

HEADLINES = (
    "sentence_pairs",
    "sentence_pairs_resplit",
    "sentence_spans",
    "pair_spans",
    "corpus_funnel",
    "document_split",
    "exact_split",
    "vocabulary",
    "token_batches",
    "document_concepts",
    "nearest_sentences",
    "retrieval_decode",
    "decoded_targets",
    "next_concept",
    "text_probe",
    "corpus_funnel_limit",
    "sentence_pairs_unique",
    "sts_spearman",
    "uniformity",
    "validation_metrics",
    "corpus_bleu",
    "rouge",
    "rouge_l",
    "generation_report",
    "perplexity",
    "top_p_filter",
    "ema_by_user",
    "stream_pairs",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINES
    queries = all_queries()
    spark = build_session(cores, "bench", spark__spanloom__inputParts=cores)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name} {[round(r, 2) for r in runs]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    result = {
        "metric": "total_query_seconds",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
