"""Scoring cluster models against a seed set, and comparing the best models.

Member lists stay in long form, one row per (model, member): a cluster can
hold any share of the documents, so it is never gathered into one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.functions.numbers import quotient
from forumlens.functions.text import model_key, pair_key
from forumlens.operators import filters
from forumlens.operators.ranking import rank_by_draw

MODEL = ["method", "k"]
TOP = 3


def top_clusters(counts: DataFrame, groups: Sequence[str], n: int = TOP, count: str = "n_seeds") -> DataFrame:
    """The n clusters with most seeds per group, ties by cluster id. The input
    has at most one row per (group, cluster)."""
    order = Window.partitionBy(*groups).orderBy(F.desc(count), "cluster")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def recall_rounds(
    labels: DataFrame, seeds: DataFrame, rounds: int = 50, seed: int = 1, key: str = "doc_id"
) -> DataFrame:
    """recall@n and total@n (n = 1..3) of every model in every round.

    A round draws half of the seeds; the clusters that hold most of them are
    the top clusters, recall is the share of the other half found there, and
    total is the number of documents there. All rounds and models are one job:
    seeds are split per round, then counted per (model, round, cluster).
    """
    numbers = F.sequence(F.lit(seed), F.lit(seed + rounds - 1))
    drawn = seeds.select(key).distinct().withColumn("round", F.explode(numbers))
    ranked = rank_by_draw(drawn, ["round"], key, F.col("round"))
    half = F.floor(seeds.select(F.count_distinct(key)).scalar() / 2)
    split = ranked.select(key, "round", (F.col("rank") <= half).alias("drawn"))
    sides = split.join(labels.select(key, *MODEL, "cluster"), key)
    counts = sides.groupBy(*MODEL, "round", "cluster").agg(
        F.count_if("drawn").alias("n_seeds"), F.count_if(~F.col("drawn")).alias("held_out")
    )
    sizes = labels.groupBy(*MODEL, "cluster").agg(F.count("*").alias("size"))
    per_round = Window.partitionBy(*MODEL, "round")
    order = per_round.orderBy(F.desc("n_seeds"), "cluster")
    ranked = (
        counts.join(sizes, [*MODEL, "cluster"])
        .withColumn("rank", F.when(F.col("n_seeds") > 0, F.row_number().over(order)))
        .withColumn("all_held_out", F.sum("held_out").over(per_round))
    )

    def inside(n: int, value: str):
        return F.sum(F.when(F.col("rank") <= n, F.col(value)).otherwise(0))

    cells = [F.max("all_held_out").alias("all_held_out")]
    for n in range(1, TOP + 1):
        cells += [inside(n, "held_out").alias(f"tp{n}"), inside(n, "size").alias(f"total{n}")]
    wide = ranked.groupBy(*MODEL, "round").agg(*cells)
    per_n = [
        F.struct(
            F.lit(n).alias("n"),
            quotient(F.col(f"tp{n}"), F.col("all_held_out"), 4).alias("recall"),
            F.col(f"total{n}").alias("total"),
        )
        for n in range(1, TOP + 1)
    ]
    return wide.select(*MODEL, "round", F.inline(F.array(*per_n)))


def cluster_recall(labels: DataFrame, seeds: DataFrame, rounds: int = 50, seed: int = 1, key: str = "doc_id") -> DataFrame:
    """Mean recall@n and total@n over the rounds."""
    return (
        recall_rounds(labels, seeds, rounds, seed, key)
        .groupBy(*MODEL, "n")
        .agg(
            quotient(F.sum(F.bround(F.col("recall") * 10_000, 0)), F.count("*") * 10_000, 4).alias("average_recall"),
            quotient(F.sum("total"), F.count("*"), 4).alias("total_subs"),
        )
    )


def recall_matrix(recall: DataFrame) -> DataFrame:
    """One row per model: recall and size at 1..3.

    One aggregate makes both pivots, which have the same keys, so there is
    nothing left to join.
    """
    keyed = recall.withColumn("key", model_key(F.col("method"), F.col("min_df"), F.col("max_df"), F.col("k")))
    columns = [
        F.max(F.when(F.col("n") == n, F.col(value))).alias(f"{n}_{suffix}")
        for value, suffix in (("average_recall", "av_recall"), ("total_subs", "av_subs"))
        for n in range(1, TOP + 1)
    ]
    return keyed.groupBy("key").agg(*columns)


def top_cluster_members(labels: DataFrame, seeds: DataFrame, key: str = "doc_id") -> DataFrame:
    """(method, k, rank, cluster, member): all documents of each model's top 3 clusters."""
    held = filters.members(labels, key, seeds).groupBy(*MODEL, "cluster").agg(F.count("*").alias("n_seeds"))
    top = top_clusters(held, MODEL).select(*MODEL, "cluster", "rank")
    return labels.join(top, [*MODEL, "cluster"]).select(*MODEL, "rank", "cluster", F.col(key).alias("member"))


def result_table(recall: DataFrame, labels: DataFrame, seeds: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per model: recall and size at 1..3, ids and sizes of its top 3 clusters.

    `recall` carries method, min_df, max_df, k, n, average_recall, total_subs.
    """
    params = recall.select(
        model_key(F.col("method"), F.col("min_df"), F.col("max_df"), F.col("k")).alias("key"),
        *MODEL,
        "min_df",
        "max_df",
    ).distinct()
    sizes = top_cluster_members(labels, seeds, key).groupBy(*MODEL, "rank", "cluster").agg(F.count("*").alias("size"))
    wide = sizes.groupBy(*MODEL).agg(
        *[F.max(F.when(F.col("rank") == n, F.col("cluster"))).alias(f"{n}_cluster_id") for n in range(1, TOP + 1)],
        *[F.max(F.when(F.col("rank") == n, F.col("size"))).alias(f"{n}_cluster_size") for n in range(1, TOP + 1)],
    )
    return params.join(recall_matrix(recall), "key", "full").join(wide, MODEL, "full")


def best_models(results: DataFrame, min_recall: float = 0.7, max_subs: int = 1500, top: int = 1) -> DataFrame:
    """Models above the recall limit whose top clusters together stay below the
    size limit. A model with fewer clusters adds nothing for the missing ones."""
    size = F.lit(0)
    for n in range(1, top + 1):
        size = size + F.coalesce(f"{n}_cluster_size", F.lit(0))
    return results.where((F.col(f"{top}_av_recall") > min_recall) & (size < max_subs)).select(
        "key", *MODEL, "min_df", "max_df", F.col(f"{top}_av_recall").alias("recall"), size.alias("total_subs")
    )


def model_members(best: DataFrame, members: DataFrame, top: int = 1) -> DataFrame:
    """(key, method, member) of the chosen models' top clusters."""
    return members.where(F.col("rank") <= top).join(best.select("key", *MODEL), MODEL).select("key", "method", "member")


def compare_models(chosen: DataFrame, best: DataFrame) -> DataFrame:
    """Members of one model that another lacks, for every ordered pair.

    Each member gathers the models that hold it (at most as many as there are
    models) and is sent once to every pair that differs in it.
    """
    models = best.select(F.array_sort(F.collect_set("key"))).scalar()
    per_member = chosen.groupBy("member").agg(F.collect_set("key").alias("has"))
    return (
        per_member.withColumn("lacks", F.array_except(models, F.col("has")))
        .select("member", F.explode("has").alias("a"), "lacks")
        .select("member", "a", F.explode("lacks").alias("b"))
        .select(pair_key(F.col("a"), F.col("b")).alias("pair"), "member")
    )


def model_pairs(models: DataFrame) -> DataFrame:
    """Every unordered pair of models once (the table has one row per model)."""
    other = models.select(F.col("key").alias("other"))
    return models.select("key").join(other, F.col("key") < F.col("other"))


def member_matrix(chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per member with a 0/1 column per model."""
    return chosen.groupBy("member").pivot("key", list(keys)).agg(F.max(F.lit(1))).fillna(0)


def member_share(chosen: DataFrame, best: DataFrame, column: str) -> DataFrame:
    """Percentage of the best models that hold each member.

    A model puts a document in one cluster, so (key, member) is unique and
    counting rows counts models.
    """
    n_models = best.select(F.count("*")).scalar()
    return chosen.groupBy("member").agg((F.count("*") * F.lit(100.0) / n_models).alias(column))


def member_shares(chosen: DataFrame, best: DataFrame) -> DataFrame:
    """Shares among the k-means models, the LDA models and all of them.

    One pass over the members gives all three, which is what joining the three
    separate tables by member would give. `best` has one row per model.
    """
    names = {"kmeans": "kmeans", "lda": "lda", "kmeans+lda": None}

    def of(method: str | None, value: str):
        return F.col(value) if method is None else F.when(F.col("method") == method, F.col(value))

    totals = {name: best.select(F.count(of(method, "key"))).scalar() for name, method in names.items()}
    held = chosen.groupBy("member").agg(*[F.count(of(method, "key")).alias(n) for n, method in names.items()])
    shares = [
        F.when(F.col(f"`{name}`") > 0, F.col(f"`{name}`") * F.lit(100.0) / total).alias(name)
        for name, total in totals.items()
    ]
    return held.select("member", *shares).orderBy(F.desc("`kmeans+lda`"), F.desc("kmeans"), F.desc("lda"), "member")


def shares_of_all(docs: DataFrame, shares: DataFrame, key: str = "doc_id") -> DataFrame:
    """Shares for every document, 0 where no model holds it."""
    joined = docs.select(key).join(shares.withColumnRenamed("member", key), key, "left")
    return joined.fillna(0.0, subset=[c for c in shares.columns if c != "member"])
