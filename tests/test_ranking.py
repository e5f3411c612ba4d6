"""Ranks, samples and running totals against brute force, with skewed groups."""

import hashlib

from pyspark.sql import functions as F

from frames import rows
from forumlens.operators import ranking


def skewed(spark, n=3000):
    """Half of all rows in one group."""
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g")
    )


def drawn(seed, keys):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


def by_group(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r.id)
    return groups


def test_sample_per_group(spark):
    df = skewed(spark)
    expected = {(g, k) for g, keys in by_group(df).items() if len(keys) >= 60 for k in drawn(7, keys)[:60]}
    for partitions in (1, 4, 50):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = {(r.g, r.id) for r in ranking.sample_per_group(df.repartition(partitions), "g", "id", 60, 7, salts=8).collect()}
        assert got == expected
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_sample_group_boundary(spark):
    df = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(5)] + [("c", i) for i in range(6)], "g STRING, id INT")
    got = by_group(ranking.sample_per_group(df, "g", "id", 5, 1))
    assert {g: len(v) for g, v in got.items()} == {"b": 5, "c": 5}


def test_rank_by_draw(spark):
    df = skewed(spark)
    expected = {(g, k, i + 1) for g, keys in by_group(df).items() for i, k in enumerate(drawn(3, keys))}
    assert {(r.g, r.id, r["rank"]) for r in ranking.rank_by_draw(df, ["g"], "id", 3).collect()} == expected


def test_row_index(spark):
    df = spark.range(0, 5000, 7).repartition(6)
    assert rows(ranking.row_index(df, "id"), "id") == [(v, i) for i, v in enumerate(range(0, 5000, 7))]


def test_running_totals(spark):
    data = [(g, float((i * 37) % 101), i % 3) for g in ("a", "b") for i in range(2000)]
    df = spark.createDataFrame(data, "g STRING, score DOUBLE, y INT").groupBy("g", "score").agg(F.sum("y").alias("y"))
    got = {(r.g, r.score): r.total for r in ranking.running_totals(df, ["g"], "score", {"total": "y"}).collect()}
    for g in ("a", "b"):
        for s in range(101):
            assert got[(g, float(s))] == sum(y for h, t, y in data if h == g and t >= s)


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, 9, "z"), (1, 2, "a")], "k INT, o INT, v STRING")
    assert rows(ranking.first_per_key(df, ["k"], ["o", "v"]), "k") == [(1, 2, "a"), (2, 9, "z")]
