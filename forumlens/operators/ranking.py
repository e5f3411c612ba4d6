"""Ranks, samples and running totals that never put a whole group in one task.

A window without a partition column, or partitioned by a few classes, sends a
group to one task. Here a group is first cut into buckets whose order agrees
with the wanted order; bucket totals (a bounded table) give every bucket its
offset, and the window runs inside the buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.functions.keys import draw_key
from forumlens.session import written

DRAW_DIGITS = 3  # 16**3 buckets per group


def rank_by_draw(df: DataFrame, groups: Sequence[str], key: str, seed: int | Column, rank: str = "rank") -> DataFrame:
    """1-based rank of every row in its group, in the order of `draw_key`.

    Buckets are the leading hex digits of the md5, so they are equal in size
    whatever the sizes of the groups.
    """
    drawn = df.withColumn("__draw", draw_key(seed, F.col(key)))
    drawn = drawn.withColumn("__bucket", F.substring("__draw", 1, DRAW_DIGITS))
    order = [F.col("__draw"), F.col(key)]
    return _rank_in_buckets(drawn, groups, order, rank).drop("__draw")


def _rank_in_buckets(df: DataFrame, groups: Sequence[str], order: list[Column], rank: str) -> DataFrame:
    cells = [*groups, "__bucket"]
    sizes = df.groupBy(*cells).agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    offsets = offsets.select(*[F.col(c).alias(f"__o{c}") for c in cells], "__offset")
    numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy(*cells).orderBy(*order)))
    on = [F.col(c).eqNullSafe(F.col(f"__o{c}")) for c in cells]
    return (
        numbered.join(offsets, on)
        .withColumn(rank, F.col("__n") + F.col("__offset"))
        .drop("__n", "__offset", "__bucket", *[f"__o{c}" for c in cells])
    )


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int, salts: int = 64) -> DataFrame:
    """n rows of every group that has at least n, drawn by `draw_key`.

    The best n of every (group, salt) are found first, so a group that holds a
    third of all rows is worked on by `salts` tasks and its last step sees at
    most n * salts rows.
    """
    drawn = df.withColumn("__draw", draw_key(seed, F.col(key)))
    drawn = drawn.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    order = [F.col("__draw"), F.col(key)]
    part = Window.partitionBy(group, "__salt").orderBy(*order)
    whole = Window.partitionBy(group)
    return (
        drawn.withColumn("__r", F.row_number().over(part))
        .where(F.col("__r") <= n)
        .withColumn("__r", F.row_number().over(whole.orderBy(*order)))
        .where(F.col("__r") <= n)
        .withColumn("__n", F.count("*").over(whole))
        .where(F.col("__n") == n)
        .drop("__draw", "__salt", "__r", "__n")
    )


def sampled_rows(df: DataFrame, sample: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """The full rows of a sample drawn by `sample_per_group` from `df`'s keys.

    A row is in the sample when its draw is not above the last one drawn in its
    group. The join has one row per group on one side: while that is small Spark
    broadcasts it, and texts are filtered where they are read.
    """
    drawn = sample.select(group, F.struct(draw_key(seed, F.col(key)).alias("d"), F.col(key).alias("k")).alias("__at"))
    last = drawn.groupBy(group).agg(F.max("__at").alias("__last"))
    here = F.struct(draw_key(seed, F.col(key)).alias("d"), F.col(key).alias("k"))
    return df.join(last, group).where(here <= F.col("__last")).drop("__last")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in `order` (a total order, ascending).

    An aggregate rather than a window: every task keeps one candidate per key
    before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    ordered = [c for c in order if c not in keys]
    best = F.min_by(F.struct(*ordered, *rest), F.struct(*ordered)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*df.columns)


def ranged(df: DataFrame, *columns: str) -> DataFrame:
    """The rows, written once with `__bucket`: buckets of about the same size in the order of the columns.

    Buckets are the partitions of a range partitioning, so there are as many
    as the session has shuffle partitions for the data, and rows with equal
    values share one.
    """
    dealt = df.repartitionByRange(*columns)
    return written(dealt.withColumn("__bucket", F.spark_partition_id()), "ranged")


def row_index(df: DataFrame, key: str, label: str = "row_index") -> DataFrame:
    """0-based row number in the order of a unique column."""
    return _rank_in_buckets(ranged(df, key), [], [F.col(key)], label).withColumn(label, F.col(label) - 1)


def running_totals(
    df: DataFrame, groups: Sequence[str], column: str, sums: dict[str, str], descending: bool = True
) -> DataFrame:
    """Add running sums to a table with one row per (groups, value of a column),
    in the order of that column. `sums` maps new names to columns.

    Groups are few (classifiers, classes); their rows are not.
    """
    step = ranged(df, *groups, column)
    cells = [*groups, "__bucket"]
    order = F.col("__bucket").desc() if descending else F.col("__bucket").asc()
    before = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = step.groupBy(*cells).agg(*[F.sum(c).alias(f"__b{name}") for name, c in sums.items()])
    offsets = totals.select(
        *[F.col(c).alias(f"__o{c}") for c in cells],
        *[F.coalesce(F.sum(f"__b{name}").over(before), F.lit(0)).alias(f"__b{name}") for name in sums],
    )
    value = F.col(column).desc() if descending else F.col(column).asc()
    inside = Window.partitionBy(*cells).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = step.select("*", *[F.sum(c).over(inside).alias(name) for name, c in sums.items()])
    on = [F.col(c).eqNullSafe(F.col(f"__o{c}")) for c in cells]
    return local.join(offsets, on).select(
        *df.columns, *[(F.col(name) + F.col(f"__b{name}")).alias(name) for name in sums]
    )
