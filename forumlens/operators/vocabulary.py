"""Term tables, vocabularies and TF-IDF.

The long form `(doc, term, tf)` gives exact answers at any vocabulary size;
`fit_vectoriser` gives ML vectors over all of a vocabulary or its most frequent terms.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumlens.functions import text as T
from forumlens.operators import ngrams
from forumlens.session import written

HOT_TERMS = 10_000


def term_table(docs: DataFrame, ids: Sequence[str], text: str, longest: int = 1) -> DataFrame:
    """(ids, term, tf) of every document, counted inside its own row: no shuffle."""
    words = T.ngrams(T.tokens(F.col(text)), longest)
    return docs.select(*ids, F.explode(T.term_counts(words)).alias("t")).select(*ids, "t.term", "t.tf")


def group_term_table(posts: DataFrame, group: str, text: str) -> DataFrame:
    """(group, term, tf) of groups of any size, without concatenating their texts.

    Each post is counted in its row and the counts are summed, so a group that
    holds a third of all posts is still spread over its terms.
    """
    return term_table(posts, [group], text).groupBy(group, "term").agg(F.sum("tf").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df, total): documents that hold the term and its corpus frequency.

    The null test is always true; a join on `term` would add it to its own
    branch only, and branches that differ cannot share one shuffle.
    """
    known = tf.where(F.col("term").isNotNull())
    return known.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def word_frequency(docs: DataFrame, words: Column) -> DataFrame:
    """`document_frequency` of the words of each row, from sums over slices of rows; no word is null."""
    slices = ngrams.ngram_counts(docs.select(words.alias("words"), F.lit(0).alias("y")), 1)
    return slices.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("total"))


def in_limits(n_docs: Column, min_df: int, max_df: float) -> Column:
    return (F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * n_docs)


def vocabulary(freq: DataFrame, n_docs: Column, min_df: int, max_df: float) -> DataFrame:
    return freq.where(in_limits(n_docs, min_df, max_df))


def excluded_terms(freq: DataFrame, n_docs: Column, min_df: int, max_df: float) -> DataFrame:
    return freq.where(~in_limits(n_docs, min_df, max_df))


def top_features(freq: DataFrame, n: int) -> DataFrame:
    """The n terms of largest corpus frequency, ties by term."""
    return freq.orderBy(F.desc("total"), "term").limit(n)


def join_vocabulary(tf: DataFrame, vocab: DataFrame, columns: Sequence[str], hot: int = HOT_TERMS) -> DataFrame:
    """Keep the terms of the vocabulary and attach its columns.

    A frequent term occurs in more than half of all documents, so joining by
    term would put those rows in one task. Rows of the `hot` most frequent
    terms, a fixed number of broadcast rows, are joined where they are; the
    other rows are spread over many terms and are joined by shuffle. How many
    terms count as hot changes the plan's work and never the result.
    """
    top = vocab.orderBy(F.desc("df"), "term").limit(hot).select("term", *columns)
    frequent = tf.join(F.broadcast(top), "term")
    rare = tf.join(F.broadcast(top.select("term")), "term", "left_anti").join(vocab.select("term", *columns), "term")
    return frequent.unionByName(rare).select(*tf.columns, *columns)


def tfidf(tf: DataFrame, ids: Sequence[str], vocab: DataFrame, n_docs: Column) -> DataFrame:
    """tf * (ln((1 + N) / (1 + df)) + 1), then unit length per document.

    A document's rows are its distinct terms, so the per-document window is
    bounded by the size of one document.
    """
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    weighted = join_vocabulary(tf, vocab, ["df"]).withColumn("w", F.col("tf") * idf)
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*ids)))
    return weighted.select(*ids, "term", "tf", (F.col("w") / length).alias("tfidf"))


def empty_documents(docs: DataFrame, key: str, kept_tf: DataFrame) -> DataFrame:
    """Documents in which no term of the vocabulary occurs."""
    return docs.join(kept_tf.select(key).distinct(), key, "left_anti")


def short_bags(docs: DataFrame, key: str, kept_tf: DataFrame, least: int = 11) -> DataFrame:
    """Documents with fewer than `least` distinct vocabulary terms (empty ones too)."""
    sizes = kept_tf.groupBy(key).agg(F.count("*").alias("n_features"))
    counted = docs.select(key).join(sizes, key, "left").withColumn("n_features", F.coalesce("n_features", F.lit(0)))
    return counted.where(F.col("n_features") < least)


def bag_of_words(docs: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """(doc, term, tf) over whitespace-separated words that are in the vocabulary.

    Words are taken as they stand, so one that carries `+` never matches. The
    counts are written: the frequent and the rare terms both read them.
    """
    words = T.term_counts(T.split_words(F.col(text)))
    tf = written(docs.select(key, F.explode(words).alias("t")).select(key, "t.term", "t.tf"), "bags")
    return join_vocabulary(tf, vocab, ["df"]).drop("df")


def vocabulary_summary(docs: DataFrame, key: str, tf: DataFrame, min_df: int, max_df: float) -> DataFrame:
    """n_features, n_stop_words and n_empty of one vocabulary."""
    n_docs = docs.select(F.count("*")).scalar()
    freq = document_frequency(tf)
    inside = in_limits(n_docs, min_df, max_df)
    counts = freq.agg(F.count_if(inside).alias("n_features"), F.count_if(~inside).alias("n_stop_words"))
    kept = join_vocabulary(tf, vocabulary(freq, n_docs, min_df, max_df), ["df"])
    filled = kept.select(F.count_distinct(key)).scalar()
    return counts.withColumn("n_empty", n_docs - filled)


def vocabulary_sweep(docs: DataFrame, tf: DataFrame, grid: DataFrame) -> DataFrame:
    """Vocabulary sizes for every `(min_df, max_df)` of the grid, from one count.

    Terms are first counted by document frequency; the grid meets that small
    histogram, not the terms.
    """
    n_docs = docs.select(F.count("*")).scalar()
    histogram = document_frequency(tf).groupBy("df").agg(F.count("*").alias("terms"))
    points = grid.select(F.collect_list(F.struct("min_df", "max_df"))).scalar()
    met = histogram.withColumn("p", F.explode(points)).select("df", "terms", "p.*")
    inside = (F.col("df") >= F.col("min_df")) & (F.col("df") <= F.col("max_df") * n_docs)
    return met.groupBy("min_df", "max_df").agg(
        F.sum(F.when(inside, F.col("terms")).otherwise(0)).alias("n_features"),
        F.sum(F.when(inside, 0).otherwise(F.col("terms"))).alias("n_stop_words"),
    )


def count_model(spark: SparkSession, terms: list[str], words: str, counts: str) -> CountVectorizerModel:
    """`CountVectorizerModel.from_vocabulary`, with all terms sent in one call.

    That sends a call for each term, so a large vocabulary waits on the driver.
    An empty one and terms that hold the separator are left to it.
    """
    joined = "\0".join(terms)
    if not terms or joined.count("\0") != len(terms) - 1:
        return CountVectorizerModel.from_vocabulary(terms, inputCol=words, outputCol=counts)
    array = spark._jvm.java.util.regex.Pattern.compile("\0").split(joined, -1)
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", array)
    model.setInputCol(words).setOutputCol(counts)
    model._set(vocabSize=len(terms))
    return model


def fit_vectoriser(
    docs: DataFrame,
    words: str,
    min_df: int = 2,
    max_df: float = 1.0,
    max_features: int | None = None,
    output: str = "features",
    counts: str = "counts",
) -> PipelineModel:
    """Fit TF-IDF vectors on an array-of-words column.

    All terms within the limits are columns, in alphabetical order; only where
    the caller asks for `max_features` are they the most frequent ones, ties by
    term. The vocabulary is a part of the model: the driver holds it and every
    executor receives it. One pass finds the terms and their weights.
    """
    n_docs = docs.count()
    tf = docs.select(F.explode(T.term_counts(F.col(words))).alias("t")).select("t.term", "t.tf")
    inside = vocabulary(document_frequency(tf), F.lit(n_docs), min_df, max_df)
    limited = inside if max_features is None else top_features(inside, max_features)
    chosen = sorted(limited.select("term", "df").collect())
    weights = [math.log((1.0 + n_docs) / (1.0 + df)) + 1.0 for _, df in chosen]
    return PipelineModel(
        [
            count_model(docs.sparkSession, [term for term, _ in chosen], words, counts),
            ElementwiseProduct(inputCol=counts, outputCol="__weighted", scalingVec=Vectors.dense(weights)),
            Normalizer(inputCol="__weighted", outputCol=output, p=2.0),
        ]
    )


def vectorise(model: PipelineModel, docs: DataFrame) -> DataFrame:
    return model.transform(docs).drop("__weighted")
