"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_REPEATS times (default 3); the
median is reported. Results go to Spark's no-op sink, so all rows are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from forumlens.functions import text as T  # noqa: E402
from forumlens.operators import classify, recall  # noqa: E402
from forumlens.operators import clusters as C  # noqa: E402
from forumlens.plans import all_queries, classifiers, models, views  # noqa: E402
from forumlens.session import build_session, written  # noqa: E402


def recall_50(spark, folder):
    return recall.cluster_recall(views.clusters(spark, folder), views.seeds(spark, folder), 50, 1)


def kmeans_30(spark, folder):
    labels, _ = C.kmeans_sweep(models.reduced_vectors(spark, folder, 50), "doc_id", "svd", [30])  # ten starts
    return labels


def grid_lr(spark, folder):
    train, _ = classifiers.prepared(spark, folder)
    points = classify.grid("LR", (1000,), (1,), C=(1.0, 10.0), penalty=("l2",))
    return classify.grid_results(classify.cross_validate(written(classify.with_folds(train)), points))


def headline() -> dict:
    q = all_queries()
    names = [
        "corpus_clean",
        "top_features",
        "tfidf",
        "sampled_posts",
        "community_term_counts",
        "class_ngram_counts",
        "fisher_exact",
        "submission_filter",
        "thread_texts",
        "roc_curve",
    ]
    return {**{n: q[n] for n in names}, "recall_50": recall_50, "kmeans_30": kmeans_30, "grid_lr": grid_lr}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = os.environ.get("BENCH_ONLY", "").split(",") if os.environ.get("BENCH_ONLY") else None
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, run in headline().items():
        if only and name not in only:
            continue
        times = []
        for attempt in range(repeats + 1):
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
