"""Filters and the seed set on hand-made rows."""

from pyspark.sql import functions as F

import pytest

from frames import rows
from forumlens.operators import corpus, filters


def with_fields(df, fields):
    """The frame with nulls for the fields that a test does not name."""
    return df.select("*", *[F.lit(None).cast("string").alias(f) for f in fields if f not in (*df.columns, "fullname")])


def test_missing_field_is_an_error(spark):
    with pytest.raises(ValueError, match="score"):
        filters.only(spark.createDataFrame([("a",)], "id STRING"), ["id", "score"])


def test_community_filter_keeps_null_language(spark):
    df = spark.createDataFrame(
        [
            ("a", "en", "public", 10, False),
            ("b", None, "restricted", 10, False),
            ("c", "fr", "public", 10, False),
            ("d", "en", "private", 10, False),
            ("e", "en", "public", 9, False),
            ("f", "en", "public", 10, True),
        ],
        "display_name STRING, lang STRING, subreddit_type STRING, subscribers BIGINT, over18 BOOLEAN",
    )
    assert [r.display_name for r in filters.filter_communities(with_fields(df, filters.COMMUNITY_FIELDS)).orderBy("display_name").collect()] == ["a", "b"]


def test_submission_filter(spark):
    names = spark.createDataFrame([("s",)], "display_name STRING")
    df = spark.createDataFrame(
        [
            ("1", "s", "u", False, "ok", "fine"),
            ("2", "s", "[deleted]", False, "ok", "fine"),
            ("3", "s", "u", True, "ok", "fine"),
            ("4", "t", "u", False, "ok", "fine"),
            ("5", "s", "u", False, "[Deleted]", "fine"),
            ("6", "s", "u", False, "ok", "REMOVED"),
            ("7", "s", "u", False, " removed", None),
            ("8", "s", "u", False, "(removed)", None),
            ("9", "s", None, False, "no author", None),
        ],
        "id STRING, subreddit STRING, author STRING, over_18 BOOLEAN, title STRING, selftext STRING",
    )
    kept = filters.filter_submissions(with_fields(df, filters.SUBMISSION_FIELDS), names).orderBy("id").collect()
    assert [r.fullname for r in kept] == ["t3_1", "t3_7", "t3_9"]


def test_comment_filter(spark):
    posts = spark.createDataFrame([("t3_1",)], "fullname STRING")
    df = spark.createDataFrame(
        [
            ("1", "t3_1", "t3_1", "hi"),
            ("2", "t3_1", "t1_1", "reply"),
            ("3", "t3_2", "t3_2", "elsewhere"),
            ("4", "t3_1", "t3_1", "[Removed]"),
            ("5", "t3_1", "t3_1", None),
        ],
        "id STRING, link_id STRING, parent_id STRING, body STRING",
    )
    assert [r.id for r in filters.filter_comments(with_fields(df, filters.COMMENT_FIELDS), posts).orderBy("id").collect()] == ["1", "5"]


def test_test_questions(spark):
    df = spark.createDataFrame([(1, 0, 2), (2, 0, 0), (3, 0, None)], "i INT, health_claim INT, send_to_mturk INT")
    assert rows(filters.override_label(df), "i") == [(1, 1, 2), (2, 0, 0), (3, 0, None)]
    assert [r.i for r in filters.without_test_questions(df).orderBy("i").collect()] == [2, 3]


def test_seed_set(spark):
    page = spark.createDataFrame(
        [("/r/Nope **Other health related subreddits** [A](/r/aa) [B](/r/BB/) /r/aa /r/Green",)], "d STRING"
    )
    links = corpus.seed_links(page, F.col("d"))
    assert [r.link for r in links.orderBy("link").collect()] == ["/r/BB/", "/r/Green/", "/r/aa/"]
    all_named = spark.createDataFrame(
        [("Aa", "/r/Aa/"), ("bb", "/r/bb/"), ("Green", "/r/Green/"), ("Health", "/r/Health/"), ("x", "/r/x/")],
        "display_name STRING, url STRING",
    )
    assert [r.display_name for r in corpus.seed_set(all_named, links).collect()] == ["Aa", "Health", "bb"]


def test_short_document_boundary(spark):
    texts = [(n, " ".join(f"w{i}" for i in range(n))) for n in (99, 100)]
    df = spark.createDataFrame(texts, "n INT, clean_text STRING")
    assert [r.n for r in corpus.drop_short(df).collect()] == [100]
    report = corpus.short_report(df, "n").collect()
    assert [(r.n, r.short_total, r.short_distinct) for r in report] == [(99, 1, 1)]


def test_describe_matches_pandas(spark):
    values = [3, 3, 9, 1, 7, 7, 7, 20]
    df = spark.createDataFrame([(v,) for v in values], "x INT")
    import pandas as pd

    expected = pd.Series(values).describe().tolist()
    got = [float(v) for v in corpus.describe(df, "x").first()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, expected))


def test_thread_concat_order(spark):
    df = spark.createDataFrame(
        [("p", 3, 1, "d", 1, None, "s", "c2"), ("p", 3, 0, "c", 1, None, "s", "c1"), ("p", 1, 0, "a b", 1, None, "s", None)],
        "post_fullname STRING, sentence_location INT, sentence_order INT, lemmatized_text STRING, health_claim INT, "
        "send_to_mturk INT, subreddit STRING, comment_fullname STRING",
    )
    thread = corpus.combine_threads(corpus.combine_sentences(df)).first()
    assert (thread.text, thread.text_w_pos) == ("a b c d", "ttta tttb cccc cccd")
