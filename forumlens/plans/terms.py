"""Queries: vocabularies, TF-IDF, n-grams and Fisher's exact test."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from forumlens.functions import text as T
from forumlens.operators import decompose, filters, ngrams, vocabulary
from forumlens.plans.registry import query
from forumlens.plans.views import (
    LABELLED_DOCS,
    SQL_TOKENS,
    TF,
    THREADS,
    clean_documents,
    labelled_docs,
    r6,
    table,
    threads,
)
from forumlens.session import written

MIN_DF, MAX_DF = 10, 0.6
LIMITS = f"df >= {MIN_DF} AND df <= {MAX_DF} * n.n"
KEPT = f"""{TF}, vocab AS (SELECT term, df, total FROM freq, n WHERE {LIMITS}),
kept AS (SELECT tf.doc_id, tf.term, tf.tf, v.df FROM tf JOIN vocab v ON v.term = tf.term)"""


def counted(spark, folder, keep=False):
    """(documents, term table, document frequencies, number of documents)

    `keep` writes the term table, for queries that read it more than once.
    """
    docs = clean_documents(spark, folder)
    tf = vocabulary.term_table(docs, ["doc_id"], "clean_text")
    if keep:
        tf = written(tf, "term_table")
    n = table(spark, folder, "documents", "doc_id").select(F.count("*")).scalar()
    return docs, tf, vocabulary.document_frequency(tf), n


def kept_terms(spark, folder):
    docs, tf, freq, n = counted(spark, folder, keep=True)
    return docs, vocabulary.join_vocabulary(tf, vocabulary.vocabulary(freq, n, MIN_DF, MAX_DF), ["df"])


@query("V1", sql=f"WITH {KEPT} SELECT doc_id, term, tf FROM kept")
def count_vectors(spark, folder):
    return kept_terms(spark, folder)[1].drop("df")


@query("C5", sql=f"WITH {TF} SELECT term FROM freq, n WHERE df >= 2 AND df <= 0.6 * n.n ORDER BY term")
def full_vocabulary(spark, folder):
    _, _, freq, n = counted(spark, folder)
    return vocabulary.vocabulary(freq, n, 2, 0.6).select("term").orderBy("term")


@query("V2", sql=f"WITH {KEPT} SELECT DISTINCT doc_id, term FROM kept")
def binary_vectors(spark, folder):
    return kept_terms(spark, folder)[1].select("doc_id", "term")


@query(
    "V5",
    sql=f"""WITH {KEPT}, w AS (SELECT doc_id, term, tf, tf * (ln((1.0 + n.n) / (1.0 + df)) + 1.0) AS w FROM kept, n)
    SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w""",
)
def tfidf(spark, folder):
    _, tf, freq, n = counted(spark, folder, keep=True)
    weighted = vocabulary.tfidf(tf, ["doc_id"], vocabulary.vocabulary(freq, n, MIN_DF, MAX_DF), n)
    return weighted.withColumn("tfidf", r6("tfidf"))


@query("V6", sql=f"WITH {TF} SELECT term, df FROM freq, n WHERE NOT ({LIMITS})")
def excluded_terms(spark, folder):
    _, _, freq, n = counted(spark, folder)
    return vocabulary.excluded_terms(freq, n, MIN_DF, MAX_DF).select("term", "df")


@query("V7", sql=f"WITH {KEPT} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kept)")
def empty_documents(spark, folder):
    docs, kept = kept_terms(spark, folder)
    return vocabulary.empty_documents(docs.select("doc_id"), "doc_id", kept)


@query(
    "V8",
    sql=f"""WITH {KEPT} SELECT (SELECT count(*) FROM vocab) AS n_features,
    (SELECT count(*) FROM freq) - (SELECT count(*) FROM vocab) AS n_stop_words,
    n.n - (SELECT count(DISTINCT doc_id) FROM kept) AS n_empty FROM n""",
)
def vocabulary_summary(spark, folder):
    docs, tf, _, _ = counted(spark, folder, keep=True)
    return vocabulary.vocabulary_summary(docs.select("doc_id"), "doc_id", tf, MIN_DF, MAX_DF)


@query("A10", sql=f"WITH {TF} SELECT term, total FROM freq")
def corpus_term_frequency(spark, folder):
    return counted(spark, folder)[2].select("term", "total")


@query("W5", sql=f"WITH {KEPT} SELECT term, df, total FROM vocab ORDER BY total DESC, term LIMIT 100")
def top_features(spark, folder):
    _, _, freq, n = counted(spark, folder)
    return vocabulary.top_features(vocabulary.vocabulary(freq, n, MIN_DF, MAX_DF), 100)


@query("V9", sql=f"WITH {TF} SELECT term, total FROM freq WHERE df >= 2 ORDER BY total DESC, term LIMIT 1000")
def most_frequent_features(spark, folder):
    freq = counted(spark, folder)[2]
    return vocabulary.top_features(freq.where(F.col("df") >= 2), 1000).select("term", "total")


@query(
    "V10",
    sql=f"""WITH {TF} SELECT m AS min_df, 0.6::DOUBLE AS max_df,
    sum(CASE WHEN df >= m AND df <= 0.6 * n.n THEN 1 ELSE 0 END)::BIGINT AS n_features,
    sum(CASE WHEN df >= m AND df <= 0.6 * n.n THEN 0 ELSE 1 END)::BIGINT AS n_stop_words
    FROM freq, n, (SELECT unnest([2, 3, 4, 5, 7, 10, 20]) AS m) GROUP BY m""",
)
def vocabulary_sweep(spark, folder):
    docs, tf, _, _ = counted(spark, folder)
    points = filters.parameter_grid(spark, min_df=[2, 3, 4, 5, 7, 10, 20], max_df=[0.6])
    return vocabulary.vocabulary_sweep(docs.select("doc_id"), tf, points)


@query(
    "V11",
    sql=f"""WITH {KEPT}, w AS (SELECT doc_id, unnest(string_split(clean_text, ' ')) AS term FROM clean)
    SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM vocab) GROUP BY doc_id, term""",
)
def bag_of_words(spark, folder):
    docs = written(clean_documents(spark, folder), "clean")
    freq = vocabulary.document_frequency(vocabulary.term_table(docs, ["doc_id"], "clean_text"))
    n = table(spark, folder, "documents", "doc_id").select(F.count("*")).scalar()
    return vocabulary.bag_of_words(docs, "doc_id", "clean_text", vocabulary.vocabulary(freq, n, MIN_DF, MAX_DF))


@query(
    "V12",
    sql=f"""WITH {KEPT}, s AS (SELECT d.doc_id, count(k.term) AS n_features FROM documents d
    LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id) SELECT * FROM s WHERE n_features < 11""",
)
def short_bags(spark, folder):
    docs, kept = kept_terms(spark, folder)
    return vocabulary.short_bags(docs.select("doc_id"), "doc_id", kept)


@query(
    "V14",
    sql="""WITH l AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, embedding FROM embeddings)
    SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, round(unnest(embedding)::DOUBLE / n, 6) AS x FROM l""",
)
def unit_rows(spark, folder):
    e = decompose.unit_rows(table(spark, folder, "embeddings", "vec_id", "embedding"), "embedding")
    return e.select("vec_id", F.posexplode("embedding").alias("dim", "x")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), r6("x").alias("x")
    )


SVD_SIZE = decompose.COMPONENTS


def document_vectors(spark, folder, max_features=None):
    docs = clean_documents(spark, folder).select("doc_id", T.tokens(F.col("clean_text")).alias("words"))
    docs = written(docs, "words")
    model = vocabulary.fit_vectoriser(docs, "words", MIN_DF, MAX_DF, max_features)
    return vocabulary.vectorise(model, docs).select("doc_id", "counts", "features"), model


@query("V13", "V14")
def truncated_svd(spark, folder):
    """Unit-length SVD coordinates of the TF-IDF vectors."""
    vectors, _ = document_vectors(spark, folder)
    coordinates, _ = decompose.truncated_svd(vectors, "doc_id", "features", SVD_SIZE)
    return decompose.unit_rows(coordinates, "svd")


@query("V15")
def explained_variance(spark, folder):
    vectors, _ = document_vectors(spark, folder)
    coordinates, _ = decompose.truncated_svd(vectors, "doc_id", "features", SVD_SIZE)
    return decompose.explained_variance(vectors, "features", coordinates, "svd")


@query(
    "V5",
    "V9",
    sql=f"""WITH {TF}, vocab AS (SELECT term, df FROM freq, n WHERE {LIMITS} ORDER BY total DESC, term LIMIT 1000),
    w AS (SELECT tf.doc_id, tf.term, tf.tf * (ln((1.0 + n.n) / (1.0 + v.df)) + 1.0) AS w FROM tf JOIN vocab v ON v.term = tf.term, n)
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w""",
)
def ml_tfidf_vectors(spark, folder):
    """The same weights as ML vectors over the 1,000 most frequent features."""
    vectors, model = document_vectors(spark, folder, 1000)
    words = F.array(*[F.lit(w) for w in model.stages[0].vocabulary])
    long = vectors.select("doc_id", F.posexplode(vector_to_array("features")).alias("at", "x")).where(F.col("x") > 0)
    return long.select("doc_id", F.get(words, F.col("at")).alias("term"), r6("x").alias("tfidf"))


# ---- n-grams ---------------------------------------------------------------------

GRAM_PARTS = """
gram_words AS (SELECT id, y, {tokens} AS w FROM gram_docs),
grams AS (
  SELECT id, y, unnest(w) AS ngram FROM gram_words
  UNION ALL SELECT id, y, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM gram_words
  UNION ALL SELECT id, y, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM gram_words),
gram_tf AS (SELECT id, y, ngram, count(*) AS tf FROM grams GROUP BY id, y, ngram),
gram_freq AS (
  SELECT ngram, CAST(len(string_split(ngram, ' ')) AS INTEGER) AS n,
         sum(CASE WHEN y = 0 THEN tf ELSE 0 END)::BIGINT AS "0_total_freq", count(*) FILTER (y = 0) AS "0_doc_freq",
         sum(CASE WHEN y = 1 THEN tf ELSE 0 END)::BIGINT AS "1_total_freq", count(*) FILTER (y = 1) AS "1_doc_freq",
         sum(tf)::BIGINT AS total_freq, count(*) AS doc_freq
  FROM gram_tf GROUP BY ngram HAVING count(*) >= 2),
totals AS (SELECT count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM gram_docs)
""".format(tokens=SQL_TOKENS.format("text"))

GRAM_DOCS = f"{LABELLED_DOCS}, gram_docs AS (SELECT doc_id AS id, y, text FROM labelled_docs)"
GRAMS = f"{GRAM_DOCS}, {GRAM_PARTS}"

# Probabilities of all tables with the same number of drawn documents, taken once for each such number.
SQL_PMF = """exp(lgamma(pos + 1.0) - lgamma(x + 1.0) - lgamma(pos - x + 1.0)
      + lgamma(neg + 1.0) - lgamma(d - x + 1.0) - lgamma(neg - (d - x) + 1.0)
      - lgamma(pos + neg + 1.0) + lgamma(d + 1.0) + lgamma(pos + neg - d + 1.0))"""

P_VALUES = f"""{GRAMS.replace("gram_freq AS (", "gram_freq AS MATERIALIZED (")},
pairs AS MATERIALIZED (SELECT DISTINCT "1_doc_freq" AS a, "0_doc_freq" AS b FROM gram_freq),
support AS MATERIALIZED (SELECT d, pos, neg, unnest(range(greatest(0, d - neg), least(pos, d) + 1)) AS x
    FROM (SELECT DISTINCT a + b AS d FROM pairs), totals),
pmf AS MATERIALIZED (SELECT d, x, {SQL_PMF} AS p FROM support),
p_values AS MATERIALIZED (SELECT t.a, t.b, least(1.0, sum(o.p)) AS p_value FROM pairs t
    JOIN pmf s ON s.d = t.a + t.b AND s.x = t.a JOIN pmf o ON o.d = s.d AND o.p <= s.p * (1 + 1e-7) GROUP BY t.a, t.b),
tested AS (SELECT g.*, p.p_value FROM gram_freq g JOIN p_values p ON p.a = g."1_doc_freq" AND p.b = g."0_doc_freq"),
sig AS (SELECT *, CASE WHEN "1_doc_freq" > "0_doc_freq" THEN 1 ELSE 0 END AS predicts FROM tested
        WHERE p_value < 0.01 AND n <= 3 AND "1_doc_freq" <> "0_doc_freq")"""


def document_ngrams(spark, folder):
    return ngrams.class_ngrams(labelled_docs(spark, folder), "text", "y")


def class_totals(spark, folder):
    marks = table(spark, folder, "labels", "toxic")
    return (
        marks.select(F.count_if(F.col("toxic") == 1)).scalar(),
        marks.select(F.count_if(F.col("toxic") == 0)).scalar(),
    )


def tested_ngrams(spark, folder):
    counted_ngrams = written(document_ngrams(spark, folder), "ngrams")
    return ngrams.with_p_values(counted_ngrams, *class_totals(spark, folder))


@query("V3", "A9", sql=f"WITH {GRAMS} SELECT * FROM gram_freq")
def class_ngram_counts(spark, folder):
    return document_ngrams(spark, folder)


@query(
    "V4",
    sql=f"""WITH {THREADS}, gram_docs AS (SELECT post_fullname AS id, health_claim AS y, text_w_pos AS text FROM labelled),
    {GRAM_PARTS} SELECT * FROM gram_freq""",
)
def positional_ngram_counts(spark, folder):
    return ngrams.class_ngrams(filters.override_label(threads(spark, folder)), "text_w_pos", "health_claim")


@query(
    "N1",
    sql=f"""WITH {GRAMS} SELECT ngram, "1_doc_freq" AS pos_in, pos - "1_doc_freq" AS pos_out, "0_doc_freq" AS neg_in,
    neg - "0_doc_freq" AS neg_out FROM gram_freq, totals""",
)
def contingency_tables(spark, folder):
    t = ngrams.contingency(document_ngrams(spark, folder), *class_totals(spark, folder))
    return t.select("ngram", "pos_in", "pos_out", "neg_in", "neg_out")


@query("N2", sql=f"WITH {P_VALUES} SELECT ngram, round(p_value, 6) AS p_value FROM tested")
def fisher_exact(spark, folder):
    return tested_ngrams(spark, folder).select("ngram", r6("p_value").alias("p_value"))


@query("N3", sql=f"WITH {P_VALUES} SELECT ngram, n, round(p_value, 6) AS p_value, predicts FROM sig")
def significant_ngrams(spark, folder):
    sig = ngrams.significant(tested_ngrams(spark, folder), 0.01)
    return sig.select("ngram", "n", r6("p_value").alias("p_value"), "predicts")


@query(
    "N4",
    sql=f"""WITH {P_VALUES} SELECT ngram, n, round(1 - p_value, 6) AS weight, "1_doc_freq" FROM sig WHERE predicts = 1 AND n <= 2""",
)
def display_weights(spark, folder):
    weights = ngrams.display_weights(ngrams.significant(tested_ngrams(spark, folder), 0.01))
    return weights.withColumn("weight", r6("weight"))


@query("N5", sql=f"""WITH {P_VALUES} SELECT n, ngram, "1_doc_freq" FROM sig WHERE "0_doc_freq" = 0""")
def exclusive_ngrams(spark, folder):
    return ngrams.exclusive(ngrams.significant(tested_ngrams(spark, folder), 0.01))
