"""Text cleaning and tokenising as column expressions.

Everything stays in the JVM except HTML entity decoding, which has no
built-in; only texts that contain `&` are sent to Python for it.
"""

from __future__ import annotations

import html
import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and prefixes that decide the results.
HTTP_PATTERN = r"https?://[a-zA-Z!$-_]+"
WWW_PATTERN = r"www[a-zA-Z!$-_]+"
NUMBER_PATTERN = r"[0-9](?<![\p{L}\p{N}_][0-9])[0-9]*+(?![\p{L}\p{N}_])"
# frequent letters are listed one by one: Java looks these up in one table and tries ranges and classes in turn
LETTERS = string.ascii_letters + "".join(chr(c) for c in range(128, 256) if chr(c).isalpha())
PUNCTUATION_PATTERN = "[^[" + LETTERS + string.digits + r"_+\x08]\p{L}\p{N}]"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
NAME_PATTERN = r"\[[a-zA-Z0-9'_ ]*\]"
LINK_PATTERN = r"/[r]/[a-zA-Z0-9_]*"
COMMUNITY_PREFIX = "/r/"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside `body`.

    Without this, an expression referenced from a lambda is evaluated again
    for every array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def flatten_whitespace(c: Column) -> Column:
    return F.translate(c, "\n\t", "  ")


def strip_http(c: Column) -> Column:
    return F.regexp_replace(c, HTTP_PATTERN, " ")


def strip_www(c: Column) -> Column:
    return F.regexp_replace(c, WWW_PATTERN, " ")


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def decode_entities(df: DataFrame, column: str) -> DataFrame:
    """HTML5 entities in `column`, one pass.

    Works on a frame so that what is already done to the column is computed
    once; texts without `&` are not sent to Python.
    """
    work = f"__{column}_decoded"
    return (
        df.withColumn(work, _unescape(F.when(F.contains(column, F.lit("&")), F.col(column))))
        .withColumn(column, F.coalesce(work, column))
        .drop(work)
    )


def strip_numbers(c: Column) -> Column:
    return F.regexp_replace(c, NUMBER_PATTERN, " ")


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION_PATTERN, " ")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " +", " ")


def strip_punctuation_and_spaces(c: Column) -> Column:
    """`collapse_spaces(strip_punctuation(c))` in one pass: runs of dropped
    characters and spaces both become one space."""
    return F.regexp_replace(c, PUNCTUATION_PATTERN + "++", " ")


def drop_community_prefix(c: Column) -> Column:
    return F.replace(c, F.lit(COMMUNITY_PREFIX), F.lit(""))


def clean_corpus_text(df: DataFrame, source: str, target: str = "clean_text") -> DataFrame:
    """Lower-case, then drop URLs, entities, numbers and punctuation.

    Newlines and tabs need no step of their own: they end a URL, border a
    number and count as punctuation exactly as the space would.
    """
    df = df.withColumn(target, strip_www(strip_http(F.lower(source))))
    df = decode_entities(df, target)
    return df.withColumn(target, strip_punctuation_and_spaces(strip_numbers(F.col(target))))


def clean_thread_text(df: DataFrame, source: str, target: str = "clean_text") -> DataFrame:
    """As above for thread sentences: case is kept and `/r/` is dropped.
    Stop words and lemmas follow as table lookups (`operators.words`)."""
    df = df.withColumn(target, strip_www(strip_http(F.col(source))))
    df = decode_entities(df, target)
    numbers_gone = strip_numbers(F.col(target))
    return df.withColumn(target, strip_punctuation_and_spaces(drop_community_prefix(numbers_gone)))


def split_words(c: Column) -> Column:
    """Whitespace split without empty strings."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def split_spaces(c: Column) -> Column:
    """Split at every single space, empty strings kept."""
    return F.split(c, " ", -1)


def tokens(c: Column) -> Column:
    """Lower-cased words of two or more characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))


def find_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def from_marker(c: Column, marker: str) -> Column:
    """The text from the first `marker` on; null when there is none."""
    at = F.locate(marker, c)
    return F.when(at > 0, F.substr(c, at))


def strip_brackets(c: Column) -> Column:
    return F.translate(c, "[]", "")


def with_trailing_slash(c: Column) -> Column:
    return F.concat(c, F.lit("/"))


def model_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" vs. "), b)


def title_and_body(title: Column, body: Column) -> Column:
    """`title, body`; a null part is empty and the separator stays."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(", "), F.coalesce(body, F.lit("")))


def prefix_terms(c: Column, prefix: Column, keep_empty: bool = False) -> Column:
    """Put `prefix` before every space-separated term."""
    terms = split_spaces(c)
    if not keep_empty:
        terms = F.filter(terms, lambda t: t != "")
    return F.array_join(F.transform(terms, lambda t: F.concat(prefix, t)), " ")


def ngrams(words: Column, longest: int) -> Column:
    """All runs of 1..longest words of an array, joined by a space."""

    def run_of(w: Column, n: int) -> Callable[[Column, Column], Column]:
        return lambda first, i: F.concat_ws(" ", first, *[F.get(w, i + F.lit(j)) for j in range(1, n)])

    def runs(w: Column) -> Column:
        parts = [w]
        for n in range(2, longest + 1):
            starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - F.lit(n - 1), F.lit(0)))
            parts.append(F.transform(starts, run_of(w, n)))
        return F.concat(*parts)

    return words if longest == 1 else bind(words, runs)


def term_counts(words: Column) -> Column:
    """Distinct words of one row with their counts, as array<struct<term, tf>>.

    Sorts the row's words and measures the runs, so a document is counted
    where it is read and its words are never shuffled.
    """

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.transform(s, lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i)),
            lambda i: i.isNotNull(),
        )
        return bind(
            starts,
            lambda p: F.transform(
                p,
                lambda at, j: F.struct(
                    F.get(s, at).alias("term"),
                    (F.coalesce(F.get(p, j + 1), n) - at).cast("bigint").alias("tf"),
                ),
            ),
        )

    return bind(F.sort_array(words), runs)
