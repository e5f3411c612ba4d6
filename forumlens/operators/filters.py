"""Record filters, key-list filters and small column operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Inclusion rules and deletion markers.
COMMUNITY_TYPES = ["public", "restricted"]
LANGUAGE = "en"
MIN_SUBSCRIBERS = 9
DELETED_AUTHOR = "[deleted]"
TITLE_MARKERS = [
    "[deleted by user]",
    "[removed by user]",
    "[deleted]",
    "[removed]",
    "(removed)",
    "removed",
    "deleted",
]
SELFTEXT_MARKERS = ["[deleted]", "[removed]", "deleted", "removed"]
BODY_MARKERS = ["[deleted by user]", "[removed]", "(removed)", "[deleted]", "deleted", "removed"]
FULLNAME_PREFIX = "t3_"
COMMUNITY_FIELDS = [
    "id",
    "name",
    "display_name",
    "title",
    "url",
    "subscribers",
    "subreddit_type",
    "description",
    "lang",
]
SUBMISSION_FIELDS = [
    "subreddit_id",
    "subreddit",
    "id",
    "fullname",
    "permalink",
    "score",
    "title",
    "selftext",
    "url",
    "author",
    "author_fullname",
    "created_utc",
    "source_file",
]
COMMENT_FIELDS = [
    "subreddit_id",
    "subreddit",
    "link_id",
    "id",
    "parent_id",
    "permalink",
    "score",
    "body",
    "source_file",
]


def only(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The named fields in the given order; a missing one is an error, not a shorter table."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"fields missing from the records: {', '.join(missing)}")
    return df.select(*fields)


def in_or_null(c: Column, *values) -> Column:
    """Membership that keeps nulls."""
    return c.isin(*values) | c.isNull()


def not_marker(c: Column, markers: Sequence[str]) -> Column:
    """True unless the whole text is a deletion marker in any case; null is kept."""
    return ~F.coalesce(F.lower(c), F.lit("")).isin(*markers)


def fullname(c: Column) -> Column:
    return F.concat(F.lit(FULLNAME_PREFIX), c)


def filter_communities(df: DataFrame) -> DataFrame:
    return only(
        df.where(
            ~F.col("over18")
            & in_or_null(F.col("lang"), LANGUAGE)
            & F.col("subreddit_type").isin(*COMMUNITY_TYPES)
            & (F.col("subscribers") > MIN_SUBSCRIBERS)
        ),
        COMMUNITY_FIELDS,
    )


def submission_rules() -> Column:
    """Live and not for adults; a record without an author's name is kept."""
    return (
        ~F.col("author").eqNullSafe(F.lit(DELETED_AUTHOR))
        & ~F.col("over_18")
        & not_marker(F.col("title"), TITLE_MARKERS)
        & not_marker(F.col("selftext"), SELFTEXT_MARKERS)
    )


def filter_submissions(df: DataFrame, communities: DataFrame, name: str = "display_name") -> DataFrame:
    """Live submissions of the listed communities, with their derived key."""
    kept = members(df.where(submission_rules()), "subreddit", communities, name)
    return only(kept.withColumn("fullname", fullname(F.col("id"))), SUBMISSION_FIELDS)


def comment_rules() -> Column:
    top_level = F.col("parent_id") == F.col("link_id")
    return top_level & not_marker(F.col("body"), BODY_MARKERS)


def filter_comments(df: DataFrame, submissions: DataFrame) -> DataFrame:
    """Top-level live comments on the listed submissions."""
    return only(members(df.where(comment_rules()), "link_id", submissions, "fullname"), COMMENT_FIELDS)


def members(df: DataFrame, key: str, keys: DataFrame, key_in: str | None = None) -> DataFrame:
    """Rows whose key is in the list. Spark broadcasts the list when its size
    allows and otherwise shuffles both sides, splitting skewed keys."""
    return df.join(_key_list(keys, key_in or key, key), key, "left_semi")


def non_members(df: DataFrame, key: str, keys: DataFrame, key_in: str | None = None) -> DataFrame:
    return df.join(_key_list(keys, key_in or key, key), key, "left_anti")


def _key_list(keys: DataFrame, name: str, key: str) -> DataFrame:
    return keys.select(F.col(name).alias(key))


def members_ignoring_case(df: DataFrame, key: str, keys: DataFrame, key_in: str | None = None) -> DataFrame:
    lowered = keys.select(F.lower(key_in or key).alias("__key"))
    return df.join(lowered, F.lower(df[key]) == lowered["__key"], "left_semi")


def override_label(df: DataFrame, label: str = "health_claim", flag: str = "send_to_mturk") -> DataFrame:
    """Test questions (flag 2) always carry the positive label."""
    return df.withColumn(label, F.when(F.col(flag) == 2, F.lit(1)).otherwise(F.col(label)))


def without_test_questions(df: DataFrame, flag: str = "send_to_mturk") -> DataFrame:
    """Drops flag 2; a null flag is no test question."""
    return df.where(~F.col(flag).eqNullSafe(F.lit(2)))


def drop_models(df: DataFrame, min_dfs: Sequence[int] = (7,), max_dfs: Sequence[float] = (1000,)) -> DataFrame:
    """Models whose vocabulary limits are listed are left out."""
    return df.where(~F.col("min_df").isin(*min_dfs) & ~F.col("max_df").isin(*max_dfs))


def parameter_grid(spark, **ranges: Sequence) -> DataFrame:
    """One row per combination of the given values."""
    grid = spark.range(1).select()
    for name, values in ranges.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return grid


def lookup(c: Column, mapping: dict) -> Column:
    """Dictionary lookup in a literal map; unknown keys give null."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), c)


def wide_to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def long_to_wide(df: DataFrame, keys: Sequence[str], name: str, values: Sequence, value: str) -> DataFrame:
    """One column per listed value of `name`; listing them saves a pass over the data."""
    return df.groupBy(*keys).pivot(name, list(values)).agg(F.first(value))


def union_distinct(*tables: DataFrame) -> DataFrame:
    return concat_rows(*tables).distinct()


def concat_rows(*tables: DataFrame) -> DataFrame:
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result
