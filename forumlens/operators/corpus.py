"""Community corpora, labelled threads and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.functions import text as T
from forumlens.functions.keys import location_prefix
from forumlens.operators import filters
from forumlens.operators.ranking import sample_per_group, sampled_rows

# Fixed values of the seed page.
SEED_MARKER = "**Other health related subreddits**"
SEED_EXCLUDED = ["Green", "VentureBiotech"]
SEED_PAGE_COMMUNITY = "Health"
MIN_DISTINCT_WORDS = 100


def ordered_concat(value: str, order: Sequence[str], sep: str) -> Column:
    """Concatenate a group's texts in a stated order.

    For groups that are one document (a thread, a sampled community). Word
    statistics of unbounded groups come from `vocabulary.group_term_table`,
    which needs no concatenated text.
    """
    pieces = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__piece"))))
    return F.array_join(F.transform(pieces, lambda p: p["__piece"]), sep)


def ordered_list(value: str, order: Sequence[str]) -> Column:
    pieces = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__piece"))))
    return F.transform(pieces, lambda p: p["__piece"])


def value_counts(df: DataFrame, *columns: str, count: str = "count") -> DataFrame:
    """Rows per value, largest first, ties by value."""
    return df.groupBy(*columns).agg(F.count("*").alias(count)).orderBy(F.desc(count), *columns)


def describe(df: DataFrame, column: str, *groups: str) -> DataFrame:
    """count, mean, std, min, quartiles (interpolated), max of a column of counts.

    Equal values are counted first, so the exact quartiles work on distinct
    values with frequencies instead of on all rows. Word and character counts
    have at most as many distinct values as the longest document has words.
    """
    freq = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count("*").alias("n"))
    x, n = F.col(column).cast("double"), F.col("n")
    total, mean_sum = F.sum(n), F.sum(x * n)
    square_sum = F.sum(x * x * n)
    quartiles = F.percentile(F.col(column), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    parts = freq.groupBy(*groups).agg(
        total.alias("count"),
        (mean_sum / total).alias("mean"),
        F.when(
            total > 1,
            F.sqrt(F.greatest(square_sum - mean_sum * mean_sum / total, F.lit(0.0)) / (total - 1)),
        ).alias("std"),
        F.min(column).alias("min"),
        quartiles.alias("q"),
        F.max(column).alias("max"),
    )
    return parts.select(
        *groups,
        "count",
        "mean",
        "std",
        "min",
        F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"),
        "max",
    )


def describe_strings(df: DataFrame, column: str, *groups: str) -> DataFrame:
    """count, distinct values, most frequent value (ties: smallest) and its frequency."""
    freq = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count("*").alias("n"))
    return freq.groupBy(*groups).agg(
        F.sum("n").alias("count"),
        F.count("*").alias("unique"),
        F.min_by(F.col(column), F.struct((-F.col("n")).alias("n"), F.col(column))).alias("top"),
        F.max("n").alias("freq"),
    )


def count_of_counts(df: DataFrame, column: str, *groups: str) -> DataFrame:
    """How many values of `column` occur once, twice, ... per group."""
    per_value = df.groupBy(*groups, column).agg(F.count("*").alias("threads"))
    return per_value.groupBy(*groups, "threads").agg(F.count("*").alias("n_values"))


def class_balance(df: DataFrame, label: str = "health_claim") -> DataFrame:
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(
        pos.alias("n_pos"), neg.alias("n_neg"), F.round(F.lit(100.0) * pos / (pos + neg), 3).alias("pct_pos")
    )


def with_word_counts(df: DataFrame, text: str = "clean_text") -> DataFrame:
    words = T.split_words(F.col(text))
    return df.withColumns(
        {
            "total_word_count": F.size(words).cast("bigint"),
            "distinct_word_count": F.size(F.array_distinct(words)).cast("bigint"),
        }
    )


def with_thread_word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts over the single-space split, in which empty terms count."""
    words = T.split_spaces(F.col(text))
    return df.withColumns(
        {
            "total_words": F.size(words).cast("bigint"),
            "distinct_words": F.size(F.array_distinct(words)).cast("bigint"),
        }
    )


def extremes(df: DataFrame, column: str) -> DataFrame:
    """All rows equal to the smallest or largest value. Reads `df` twice."""
    ends = df.select(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    which = F.when(F.col(column) == low, "min").otherwise("max")
    return df.where((F.col(column) == low) | (F.col(column) == high)).withColumn("extreme", which)


def drop_short(df: DataFrame, least: int = MIN_DISTINCT_WORDS, text: str = "clean_text") -> DataFrame:
    """Documents with at least `least` distinct words."""
    kept = with_word_counts(df, text).where(F.col("distinct_word_count") >= least)
    return kept.drop("total_word_count", "distinct_word_count")


def short_report(df: DataFrame, key: str, least: int = MIN_DISTINCT_WORDS, text: str = "clean_text") -> DataFrame:
    """Documents below the limit in total or in distinct words."""
    counted = with_word_counts(df, text).select(key, "total_word_count", "distinct_word_count")
    return counted.where((F.col("total_word_count") < least) | (F.col("distinct_word_count") < least)).select(
        key,
        "total_word_count",
        "distinct_word_count",
        (F.col("total_word_count") < least).cast("int").alias("short_total"),
        (F.col("distinct_word_count") < least).cast("int").alias("short_distinct"),
    )


def exclusion_summary(df: DataFrame, least: int = MIN_DISTINCT_WORDS, text: str = "clean_text") -> DataFrame:
    """Word-count summaries before and after the short documents are dropped."""
    counted = with_word_counts(df, text).select("total_word_count", "distinct_word_count")
    both, original = F.array(F.lit("original"), F.lit("final")), F.array(F.lit("original"))
    in_corpus = counted.withColumn(
        "corpus", F.explode(F.when(F.col("distinct_word_count") >= least, both).otherwise(original))
    )
    long = in_corpus.unpivot("corpus", ["total_word_count", "distinct_word_count"], "measure", "value")
    return describe(long, "value", "corpus", "measure")


def sampled_posts(posts: DataFrame, communities: DataFrame, n: int, seed: int, group: str = "subreddit") -> DataFrame:
    """n posts of every listed community that has at least n, with its URL.

    `communities(subreddit, sub_url)`; eligibility counts the posts at hand.
    """
    drawn = sample_per_group(filters.members(posts, group, communities), group, "fullname", n, seed)
    return drawn.join(communities.select(group, "sub_url"), group, "left")


def community_corpus(posts: DataFrame, sample: DataFrame, seed: int, group: str = "subreddit") -> DataFrame:
    """One row per community: its sampled posts as one text, and their ids.

    `sample` is a written `sampled_posts` table drawn with `seed`. A community
    has as many posts here as the sample drew, so its row is bounded.
    """
    texts = sampled_rows(posts, sample, group, "fullname", seed).select(
        group, "fullname", T.title_and_body(F.col("title"), F.col("selftext")).alias("concat_text")
    )
    return texts.groupBy(group).agg(
        F.trim(ordered_concat("concat_text", ["fullname"], ", ")).alias("text"),
        F.sort_array(F.collect_list("fullname")).alias("posts"),
    )


def label_seeds(corpus: DataFrame, seeds: DataFrame, key: str, seed_key: str, label: str = "health") -> DataFrame:
    """1 for the documents in the seed set, 0 for all others."""
    marked = seeds.select(F.col(seed_key).alias(key)).distinct().withColumn("__seed", F.lit(1))
    return corpus.join(marked, key, "left").withColumn(label, F.coalesce("__seed", F.lit(0))).drop("__seed")


def seed_links(pages: DataFrame, description: Column, marker: str | None = SEED_MARKER) -> DataFrame:
    """Distinct community links of the pages: `/r/name/`."""
    part = description if marker is None else T.from_marker(description, marker)
    links = pages.select(F.explode(T.find_all(part, T.LINK_PATTERN)).alias("link")).distinct()
    return links.select(T.with_trailing_slash(F.col("link")).alias("link"))


def seed_set(
    communities: DataFrame,
    links: DataFrame,
    excluded: Sequence[str] = SEED_EXCLUDED,
    own: str = SEED_PAGE_COMMUNITY,
) -> DataFrame:
    """Linked communities without the excluded ones, plus the page's own, by name."""
    listed = communities.select("display_name", "url")
    linked = filters.members_ignoring_case(listed, "url", links, "link").where(~F.col("display_name").isin(*excluded))
    return linked.unionByName(listed.where(F.col("display_name") == own)).orderBy("display_name", "url")


def with_location_terms(sentences: DataFrame, text: str, keep_empty: bool = False) -> DataFrame:
    prefix = location_prefix(F.col("sentence_location"))
    return sentences.withColumn("text_w_pos", T.prefix_terms(F.col(text), prefix, keep_empty))


def combine_sentences(sentences: DataFrame, text: str = "lemmatized_text") -> DataFrame:
    """One row per (post, location): its sentences in order, with and without
    location prefixes, and the attributes of its first sentence."""
    order = F.struct("sentence_order")
    grouped = with_location_terms(sentences, text).groupBy("post_fullname", "sentence_location")
    return grouped.agg(
        F.min_by("health_claim", order).alias("health_claim"),
        F.min_by("send_to_mturk", order).alias("send_to_mturk"),
        F.min_by("subreddit", order).alias("subreddit"),
        F.min_by("comment_fullname", order).alias("comment_fullname"),
        ordered_concat(text, ["sentence_order"], " ").alias("text"),
        ordered_concat("text_w_pos", ["sentence_order"], " ").alias("text_w_pos"),
    ).withColumnRenamed("sentence_location", "text_location")


def combine_threads(locations: DataFrame) -> DataFrame:
    """One row per post: its locations in order, and the attributes of the first."""
    order = F.struct("text_location")
    return locations.groupBy("post_fullname").agg(
        F.min_by("health_claim", order).alias("health_claim"),
        F.min_by("send_to_mturk", order).alias("send_to_mturk"),
        F.min_by("subreddit", order).alias("subreddit"),
        ordered_concat("text", ["text_location"], " ").alias("text"),
        ordered_concat("text_w_pos", ["text_location"], " ").alias("text_w_pos"),
    )


def labelled_threads(threads: DataFrame) -> DataFrame:
    """Label override, then the modelling set without test questions."""
    return filters.without_test_questions(filters.override_label(threads))
