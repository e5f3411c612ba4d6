"""Cleaning steps on texts the given tables lack."""

from pyspark.sql import functions as F

from forumlens.functions import text as T
from forumlens.functions.keys import location_prefix
from forumlens.operators import words


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t STRING").select(expression(F.col("t"))).first()[0]


def cleaned(spark, value, clean):
    return clean(spark.createDataFrame([(value,)], "t STRING"), "t").first()["clean_text"]


def test_urls(spark):
    assert one(spark, "see http://a.b/c?d=1%20e ok", T.strip_http) == "see   ok"
    assert one(spark, "HTTP://X.Y stays", T.strip_http) == "HTTP://X.Y stays"
    assert one(spark, "an awwwful day", T.strip_www) == "an a  day"
    long = "x http://a/" + "b" * 60_000 + " y"
    assert one(spark, long, T.strip_http) == "x   y"


def test_entities_are_decoded_once(spark):
    df = spark.createDataFrame([("&amp;lt; &#39; &nbsp;&eacute;",), ("plain",), (None,)], "t STRING")
    assert [r.t for r in T.decode_entities(df, "t").collect()] == ["&lt; ' \xa0é", "plain", None]


def test_unicode_words_survive(spark):
    assert one(spark, "café c++ 12 número_1 x۳", T.strip_numbers) == "café c++   número_1 x۳"
    assert one(spark, "café, c++!\t(número_1)", T.strip_punctuation_and_spaces) == "café c++ número_1 "
    assert one(spark, "Café c++ 12 número_1 a", T.tokens) == ["café", "12", "número_1"]


def test_one_pass_equals_two_steps(spark):
    value = "a--b  c,, \n d+ _e_ \x08 é§ü"
    two = one(spark, value, lambda c: T.collapse_spaces(T.strip_punctuation(c)))
    assert one(spark, value, T.strip_punctuation_and_spaces) == two


def test_corpus_and_thread_pipelines(spark):
    value = "See HTTPS://X.y/Z?1 &amp; /r/Health:\n42 Cafés, 3d!\twww.foo.org"
    assert cleaned(spark, value, T.clean_corpus_text) == "see r health cafés 3d "
    assert cleaned(spark, value, T.clean_thread_text) == "See HTTPS X y Z Health Cafés 3d "


def test_splits_keep_or_drop_empty_terms(spark):
    assert one(spark, " a  b ", T.split_words) == ["a", "b"]
    assert one(spark, " a  b ", T.split_spaces) == ["", "a", "", "b", ""]


def test_title_and_body_keeps_separator(spark):
    df = spark.createDataFrame([(None, "b"), ("a", None)], "t STRING, b STRING")
    assert [r[0] for r in df.select(T.title_and_body(F.col("t"), F.col("b"))).collect()] == [", b", "a, "]


def test_marker_absent_gives_null(spark):
    assert one(spark, "x **m** y", lambda c: T.from_marker(c, "**m**")) == "**m** y"
    assert one(spark, "x y", lambda c: T.from_marker(c, "**m**")) is None


def test_prefixes(spark):
    keep = one(spark, "a  b", lambda c: T.prefix_terms(c, F.lit("ttt"), keep_empty=True))
    assert keep == "ttta ttt tttb"
    assert one(spark, "a  b", lambda c: T.prefix_terms(c, F.lit("ttt"))) == "ttta tttb"
    assert one(spark, "7", lambda c: location_prefix(c.cast("int"))) == "ccc"
    assert one(spark, "9", lambda c: location_prefix(c.cast("int"))) is None


def test_ngrams_and_counts(spark):
    grams = one(spark, "aa bb aa", lambda c: T.ngrams(T.tokens(c), 3))
    assert grams == ["aa", "bb", "aa", "aa bb", "bb aa", "aa bb aa"]
    counts = one(spark, "bb aa bb", lambda c: T.term_counts(T.tokens(c)))
    assert [(r.term, r.tf) for r in counts] == [("aa", 1), ("bb", 2)]
    assert one(spark, "", lambda c: T.term_counts(T.ngrams(T.tokens(c), 3))) == []
    assert one(spark, "aa", lambda c: T.ngrams(T.tokens(c), 3)) == ["aa"]


def test_stop_words_and_lemmas(spark):
    df = spark.createDataFrame([(1, "The cats see THE being"), (2, "the")], "id INT, t STRING")
    lemmas = spark.createDataFrame([("cats", "noun", "cat"), ("being", "verb", "be"), ("see", "verb", "the")], "token STRING, pos STRING, lemma STRING")
    plain = words.stop_and_lemmatise(df, ["id"], "t", ["the"], lemmas, "out")
    assert [r.out for r in plain.orderBy("id").collect()] == ["cat be", ""]
    tags = spark.createDataFrame([(1, 1, "NNS"), (1, 2, "VB"), (1, 4, "NN")], "id INT, pos_in_text INT, tag STRING")
    tagged = words.stop_and_lemmatise(df, ["id"], "t", ["the"], lemmas, "out", tags)
    assert [r.out for r in tagged.orderBy("id").collect()] == ["cat being", ""]


def test_patterns_with_listed_letters_match_what_ranges_matched(spark):
    """Every code point, and numbers beside letters of all kinds (F22)."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    every = ["".join(f"a{chr(c)}" for c in points[i : i + 5000]) for i in range(0, len(points), 5000)]
    df = spark.createDataFrame([(t,) for t in [*every, "1 a2 3b 4é é5 6 78 _9 9_ 10,11 +12 ² 3²"]], "t STRING")
    plain = F.regexp_replace("t", r"[^a-zA-Z0-9_+\x08\p{L}\p{N}]++", " ")
    numbers = F.regexp_replace("t", r"(?=[0-9])(?<![\p{L}\p{N}_])[0-9]++(?![\p{L}\p{N}_])", " ")
    same = T.strip_punctuation_and_spaces(F.col("t")).eqNullSafe(plain) & T.strip_numbers(F.col("t")).eqNullSafe(numbers)
    assert "[^[" in T.PUNCTUATION_PATTERN and df.where(~same).count() == 0
