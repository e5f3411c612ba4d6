"""Vocabularies, TF-IDF, n-grams and Fisher's test."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from forumlens.functions import text as T
from forumlens.operators import ngrams, vocabulary, words

DOCS = [(1, "aa aa bb"), (2, "aa cc"), (3, "aa bb dd"), (4, ""), (5, "aa ee+ff")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id INT, t STRING")


def parts(spark):
    d = docs(spark)
    tf = vocabulary.term_table(d, ["doc_id"], "t")
    return d, tf, vocabulary.document_frequency(tf), F.lit(5)


def test_limits_are_inclusive(spark):
    _, _, freq, n = parts(spark)
    kept = {r.term for r in vocabulary.vocabulary(freq, n, 2, 0.4).collect()}
    assert kept == {"bb"}
    assert "aa" in {r.term for r in vocabulary.vocabulary(freq, n, 4, 0.8).collect()}
    out = {r.term for r in vocabulary.excluded_terms(freq, n, 2, 0.4).collect()}
    assert out | kept == {r.term for r in freq.collect()} and not out & kept


def test_hot_and_cold_terms_give_one_result(spark):
    _, tf, freq, _ = parts(spark)
    expected = {(r.doc_id, r.term, r.tf) for r in tf.collect()}
    for hot in (1, 2, 100):
        joined = vocabulary.join_vocabulary(tf, freq, ["df"], hot)
        assert {(r.doc_id, r.term, r.tf) for r in joined.collect()} == expected
        assert joined.count() == len(expected)


def test_tfidf_by_hand(spark):
    _, tf, freq, n = parts(spark)
    got = {(r.doc_id, r.term): r.tfidf for r in vocabulary.tfidf(tf, ["doc_id"], freq, n).collect()}
    aa, bb = 2 * (math.log(6 / 5) + 1), math.log(6 / 3) + 1
    assert abs(got[(1, "aa")] - aa / math.hypot(aa, bb)) < 1e-12
    assert abs(got[(1, "bb")] - bb / math.hypot(aa, bb)) < 1e-12


def test_ml_vectors_equal_the_table(spark):
    d, tf, freq, n = parts(spark)
    listed = d.withColumn("words", T.tokens(F.col("t")))
    model = vocabulary.fit_vectoriser(listed, "words", 1, 1.0)
    terms = model.stages[0].vocabulary
    assert list(terms) == sorted(terms)
    table = {(r.doc_id, r.term): r.tfidf for r in vocabulary.tfidf(tf, ["doc_id"], freq, n).collect()}
    for r in vocabulary.vectorise(model, listed).select("doc_id", vector_to_array("features").alias("v")).collect():
        for term, value in zip(terms, r.v):
            assert abs(value - table.get((r.doc_id, term), 0.0)) < 1e-12


def test_feature_limit_breaks_ties_by_term(spark):
    listed = docs(spark).withColumn("words", T.tokens(F.col("t")))
    model = vocabulary.fit_vectoriser(listed, "words", 1, 1.0, max_features=3)
    assert list(model.stages[0].vocabulary) == ["aa", "bb", "cc"]


def test_empty_and_short_documents(spark):
    d, tf, freq, n = parts(spark)
    kept = vocabulary.join_vocabulary(tf, vocabulary.vocabulary(freq, n, 2, 0.4), ["df"])
    assert {r.doc_id for r in vocabulary.empty_documents(d, "doc_id", kept).collect()} == {2, 4, 5}
    short = vocabulary.short_bags(d, "doc_id", kept, 1).collect()
    assert {(r.doc_id, r.n_features) for r in short} == {(2, 0), (4, 0), (5, 0)}


def test_bag_of_words_ignores_plus_words(spark):
    d, _, freq, _ = parts(spark)
    got = {(r.doc_id, r.term) for r in vocabulary.bag_of_words(d, "doc_id", "t", freq).collect()}
    assert (5, "aa") in got and (5, "ee") not in got


def test_group_counts_need_no_concatenation(spark):
    d = docs(spark).withColumn("g", F.lit("x"))
    got = {r.term: r.tf for r in vocabulary.group_term_table(d, "g", "t").collect()}
    assert got == {"aa": 5, "bb": 2, "cc": 1, "dd": 1, "ee": 1, "ff": 1}


def test_fisher_known_values():
    assert abs(ngrams.fisher_two_sided(8, 1, 10, 6)[0] - 0.034965) < 1e-6
    assert abs(ngrams.fisher_two_sided(0, 3, 10, 10)[0] - 0.210526) < 1e-6
    assert ngrams.fisher_two_sided(5, 5, 10, 10) == 1.0


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 80), st.integers(1, 80), st.data())
def test_fisher_against_exact_sums(pos, neg, data):
    a, b = data.draw(st.integers(0, pos)), data.draw(st.integers(0, neg))

    def weight(x):
        return math.comb(pos, x) * math.comb(neg, a + b - x)

    support = range(max(0, a + b - neg), min(pos, a + b) + 1)
    exact = sum(weight(x) for x in support if weight(x) * 10**7 <= weight(a) * (10**7 + 1)) / math.comb(pos + neg, a + b)
    p = ngrams.fisher_two_sided(a, b, pos, neg)[0]
    assert abs(p - exact) < 1e-9 and 0 < p <= 1


def test_class_ngrams_and_selection(spark):
    df = spark.createDataFrame([(f"xx yy {i}{i}", 1) for i in range(8)] + [(f"zz yy {i}{i}", 0) for i in range(8)], "t STRING, y INT")
    tested = ngrams.with_p_values(ngrams.class_ngrams(df, "t", "y", 2), F.lit(8), F.lit(8))
    sig = {r.ngram: r.predicts for r in ngrams.significant(tested, 0.01).collect()}
    assert sig == {"xx": 1, "xx yy": 1, "zz": 0, "zz yy": 0}
    assert {r.ngram for r in ngrams.exclusive(ngrams.significant(tested, 0.01)).collect()} == {"xx", "xx yy"}


def test_ngrams_are_counted_over_many_rows_at_a_time(spark, monkeypatch):
    """Null texts and labels, rows of few words, repeated rows; slices of any size give the same counts."""
    words = "aa bb aa cc bb aa dd".split()
    draw = np.random.default_rng(3)
    texts = [(" ".join(draw.choice(words, draw.integers(0, 9))), [0, 1, None][draw.integers(0, 3)]) for _ in range(40)]
    texts += [(None, 1), ("", 0), ("aa", None), *texts[:4]]
    expected = {}
    for text, y in texts:
        w = (text or "").split()
        grams = [" ".join(w[i : i + n]) for n in range(1, 6) for i in range(len(w) - n + 1)]
        for g in set(grams):
            found = expected.setdefault(g, [0, 0, 0, 0])
            if y is not None:
                found[2 * y] += grams.count(g)
                found[2 * y + 1] += 1
    expected = {g: tuple(n) for g, n in expected.items() if n[1] + n[3] >= 2}
    df = spark.createDataFrame(texts, "text string, y int").coalesce(2)
    slices = ngrams.ngram_counts(df.select(T.tokens("text").alias("words"), "y"), 3)
    assert slices.where("term = 'aa'").count() <= 6  # one row for each task and label, not one for each document
    for size in (1, 7, 1 << 19):
        monkeypatch.setattr(ngrams, "SLICE_WORDS", size)
        got = ngrams.class_ngrams(df, "text", "y", 5).collect()
        assert {r.ngram: (r["0_total_freq"], r["0_doc_freq"], r["1_total_freq"], r["1_doc_freq"]) for r in got} == expected
        assert all(r.n == len(r.ngram.split()) and r.doc_freq == r["0_doc_freq"] + r["1_doc_freq"] for r in got)


def test_ngram_counts_travel_in_blocks(spark, monkeypatch):
    """One shuffled row for a bucket of n-grams of a slice, not one for each n-gram; any number of buckets (F24-F27)."""
    texts = [(f"aa bb{i % 3} cc{i} aa", [0, 1, None, 2][i % 4]) for i in range(24)] + [("éé 中文", 1), ("éé 中文", 0), (None, 1), ("", None)]
    df = spark.createDataFrame(texts, "text string, y int").coalesce(2)
    found = ngrams.class_ngrams(df, "text", "y", 2)
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    rows = df.select(T.tokens("text").alias("words"), "y")
    assert rows.mapInArrow(ngrams._in_buckets(2, 4), "bucket int, block binary").count() <= 8
    wanted = {"aa": (12, 6, 12, 6, 1), "éé": (1, 1, 1, 1, 1), "中文": (1, 1, 1, 1, 1), "éé 中文": (1, 1, 1, 1, 2)}
    for least in range(3):
        wanted |= {g: (2, 2, 2, 2, len(g.split())) for g in (f"bb{least}", f"aa bb{least}")}
    for buckets in (1, 3, 1 << 12):
        monkeypatch.setattr(ngrams, "BUCKETS", buckets)
        got = {r.ngram: (*(r[c] for c in ngrams.CLASS_COUNTS), r.n) for r in ngrams.class_ngrams(df, "text", "y", 2).collect()}
        assert got == wanted
        none = ngrams.class_ngrams(df, "text", "y", 2, 0).where("doc_freq = 0").collect()
        assert {"cc2", "cc3", "cc3 aa", "bb2 cc2"} <= {r.ngram for r in none}  # only in rows of neither class


def test_bag_of_words_cleans_texts_once(spark):
    """The plan of the result reads written counts: no text is split in it."""
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb+ bb cc")], "doc_id long, text string")
    vocab = spark.createDataFrame([("aa", 1), ("bb", 2)], "term string, df long")
    found = vocabulary.bag_of_words(docs, "doc_id", "text", vocab)
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, "aa", 2), (1, "bb", 1), (2, "bb", 1)]


def test_vocabulary_is_sent_in_one_call(spark, monkeypatch):
    """Terms of any kind keep their order; one call for each term would never end on a large vocabulary."""
    words = ["", " ", "aa", "a\tb", "\n", "é", "中文", "\U0001f600", "zz"]
    for terms in (words, [*words, "with\0nul"], words[:1], words[2:3]):
        model = vocabulary.count_model(spark, terms, "words", "counts")
        assert model.vocabulary == terms and model.getInputCol() == "words" and model.getVocabSize() == len(terms)
        row = spark.createDataFrame([(terms + terms[:1],)], "words array<string>")
        assert model.transform(row).first().counts.toArray().tolist() == [2.0] + [1.0] * (len(terms) - 1)
    monkeypatch.setattr(CountVectorizerModel, "_new_java_array", None)
    d = spark.createDataFrame([(["aa", "bb"],), (["bb"],)], "words array<string>")
    assert vocabulary.fit_vectoriser(d, "words", 1).stages[0].vocabulary == ["aa", "bb"]


def test_removed_words_of_rows_with_one_id_and_of_none(spark):
    """Rows of one id are one text in order of place, null ids and texts are empty; only sets of words travel (F21)."""
    rows = [(1, "bb aa  cc aa dd"), (1, "zz aa bb"), (2, "aa aa"), (3, None), (None, "bb cc"), (4, " ee\x1cff\x85gg ")]
    df = spark.createDataFrame(rows, "doc_id INT, t STRING")
    listed = spark.createDataFrame([("aa",), ("gg",), ("nn",), (None,)], "term STRING")
    staying = spark.createDataFrame([("bb",), ("cc",)], "term STRING")
    wanted = [(1, "bb zz bb cc dd")] * 2 + [(2, ""), (3, ""), (4, "ee\x1cff"), (None, "")]
    for some in (None, staying):
        got = words.remove_words(df, ["doc_id"], "t", listed, "out", some)
        assert sorted(((r.doc_id, r.out) for r in got.collect()), key=str) == sorted(wanted, key=str)
    freq = vocabulary.word_frequency(df, T.split_words(F.col("t")))
    assert {(r.term, r.df, r.total) for r in freq.where("term IN ('aa', 'bb')").collect()} == {("aa", 3, 5), ("bb", 3, 3)}
