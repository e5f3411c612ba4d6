"""Recall by repeated split and the comparison of models, against brute force."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from frames import rows
from forumlens.operators import clusters, recall

LABELS = "doc_id INT, method STRING, k INT, cluster INT"


def labels(spark):
    """100 documents; cluster 0 holds most, 2 and 3 tie in seeds."""
    data = [(i, "kmeans", 4, 0 if i < 55 else 1 + i % 3) for i in range(100)]
    data += [(i, "lda", 2, i % 2) for i in range(100)]
    return spark.createDataFrame(data, LABELS), data


SEEDS = [1, 2, 3, 4, 5, 6, 7, 60, 61, 62, 63]  # an odd number


def brute_force(data, rounds):
    got = {}
    for method in ("kmeans", "lda"):
        cluster = {d: c for d, m, _, c in data if m == method}
        size = Counter(cluster.values())
        for r in range(1, rounds + 1):
            order = sorted(SEEDS, key=lambda d: hashlib.md5(f"{r}:{d}".encode()).hexdigest())
            drawn, held = order[: len(order) // 2], order[len(order) // 2 :]
            counts = Counter(cluster[d] for d in drawn)
            top = sorted(counts, key=lambda c: (-counts[c], c))
            for n in (1, 2, 3):
                hit = sum(cluster[d] in top[:n] for d in held)
                got[(method, r, n)] = (round(hit / len(held), 4), sum(size[c] for c in top[:n]))
    return got


def test_recall_rounds(spark):
    df, data = labels(spark)
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "doc_id INT")
    expected = brute_force(data, 8)
    for partitions in (1, 4, 50):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = recall.recall_rounds(df.repartition(partitions), seeds, 8).collect()
        assert {(r.method, r.round, r.n): (r.recall, r.total) for r in got} == expected
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_recall_does_not_fall_with_n(spark):
    df, _ = labels(spark)
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "doc_id INT")
    got = {(r.method, r.n): (r.average_recall, r.total_subs) for r in recall.cluster_recall(df, seeds, 5).collect()}
    for method in ("kmeans", "lda"):
        assert got[(method, 1)] <= got[(method, 2)] <= got[(method, 3)]


def test_top_cluster_without_held_out_seed(spark):
    """All drawn seeds in cluster 0, all others elsewhere: recall 0, no error."""
    seeds = [1, 2]
    order = sorted(seeds, key=lambda d: hashlib.md5(f"1:{d}".encode()).hexdigest())
    df = spark.createDataFrame([(order[0], "kmeans", 2, 0), (order[1], "kmeans", 2, 1)], LABELS)
    got = recall.recall_rounds(df, spark.createDataFrame([(s,) for s in seeds], "doc_id INT"), 1).collect()
    assert {(r.n, r.recall, r.total) for r in got} == {(1, 0.0, 1), (2, 0.0, 1), (3, 0.0, 1)}


def test_top_clusters_break_ties_by_id(spark):
    counts = spark.createDataFrame([("m", 1, c, n) for c, n in ((5, 2), (3, 2), (9, 7), (1, 1))], "method STRING, k INT, cluster INT, n_seeds INT")
    got = rows(recall.top_clusters(counts, ["method", "k"]).select("rank", "cluster"), "rank")
    assert got == [(1, 9), (2, 3), (3, 5)]


CHOSEN = [("a", "kmeans", 1), ("a", "kmeans", 2), ("b", "lda", 2), ("b", "lda", 3), ("c", "kmeans", 2)]


def test_model_comparison(spark):
    chosen = spark.createDataFrame(CHOSEN, "key STRING, method STRING, member INT")
    best = chosen.select("key", "method").distinct()
    members = {k: {m for x, _, m in CHOSEN if x == k} for k in "abc"}
    expected = {(f"{x} vs. {y}", m) for x in "abc" for y in "abc" if x != y for m in members[x] - members[y]}
    assert {tuple(r) for r in recall.compare_models(chosen, best).collect()} == expected
    shares = [tuple(r) for r in recall.member_shares(chosen, best).collect()]
    assert [m for m, *_ in shares] == [2, 1, 3]
    assert [round(v, 3) for v in shares[0][1:]] == [100.0, 100.0, 100.0]
    assert shares[1][1] == 50.0 and shares[1][2] is None
    matrix = rows(recall.member_matrix(chosen, ["a", "b", "c"]), "member")
    assert matrix == [(1, 1, 0, 0), (2, 1, 1, 1), (3, 0, 1, 0)]


def test_best_models_limits(spark):
    results = spark.createDataFrame(
        [("x", "kmeans", 4, 2, 0.6, 0.71, 1499), ("y", "kmeans", 4, 2, 0.6, 0.7, 10), ("z", "kmeans", 4, 2, 0.6, 0.9, 1500)],
        "key STRING, method STRING, k INT, min_df INT, max_df DOUBLE, 1_av_recall DOUBLE, 1_cluster_size INT",
    )
    assert [r.key for r in recall.best_models(results).collect()] == ["x"]


def test_new_members_of_the_top_cluster(spark):
    df, _ = labels(spark)
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "doc_id INT")
    got = clusters.new_members(df, seeds, "kmeans", 4).collect()
    assert len(got) == 55 and sum(r.seed for r in got) == 7 and {r.cluster for r in got} == {0}


def test_percentages_round_to_even(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id INT")
    shares = spark.createDataFrame([(1, 12.5), (2, 13.5)], "doc_id INT, lda DOUBLE")
    assert rows(clusters.percentage_layer(docs, shares, "lda"), "doc_id") == [(1, 12), (2, 14), (3, 0)]
