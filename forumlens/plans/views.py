"""Forum-shaped views of the given tables, in Spark and in SQL.

Documents stand in for submissions, conversations for labelled threads, pages
for about-pages. The SQL texts are the same views as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.functions import text as T
from forumlens.operators import corpus, filters, words
from forumlens.sources.tables import read_table, spread

STOP_WORDS = ["the", "of", "and", "to", "in", "is", "de", "la", "le", "que", "les", "der", "die", "und", "el", "en"]


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = read_table(spark, f"{folder}/{name}.parquet", columns or None)
    return spread(df) if {"text", "html"} & set(columns) else df


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# ---- submissions and communities -------------------------------------------------

SUBMISSIONS = """
submissions AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id, 't3_' || d.doc_id AS fullname,
         d.source || '_' || d.lang AS subreddit, 't5_' || d.source || '_' || d.lang AS subreddit_id,
         '/r/' || d.source || '_' || d.lang || '/comments/' || d.doc_id AS permalink,
         'https://forum.example/' || d.doc_id AS url,
         CASE WHEN l.quality = 0 THEN '[deleted]' WHEN d.doc_id % 11 <> 3 THEN 'u' || d.doc_id END AS author,
         't2_' || d.doc_id % 97 AS author_fullname, 1500000000 + d.doc_id AS created_utc, 'RS_' || d.lang AS source_file,
         coalesce(l.toxic = 1, false) AS over_18,
         CASE WHEN d.n_chars < 40 THEN '[Removed]' ELSE split_part(d.text, chr(10), 1) END AS title,
         CASE WHEN contains(d.text, chr(10)) THEN substr(d.text, instr(d.text, chr(10)) + 1) END AS selftext,
         d.n_chars AS score
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "text", "lang", "source", "n_chars")
    marks = table(spark, folder, "labels", "doc_id", "quality", "toxic")
    newline = F.locate("\n", F.col("text"))
    return d.join(marks, "doc_id", "left").select(
        "doc_id",
        F.col("doc_id").cast("string").alias("id"),
        filters.fullname(F.col("doc_id").cast("string")).alias("fullname"),
        F.concat("source", F.lit("_"), "lang").alias("subreddit"),
        F.concat(F.lit("t5_"), "source", F.lit("_"), "lang").alias("subreddit_id"),
        F.concat(F.lit("/r/"), "source", F.lit("_"), "lang", F.lit("/comments/"), "doc_id").alias("permalink"),
        F.concat(F.lit("https://forum.example/"), "doc_id").alias("url"),
        F.when(F.col("quality") == 0, "[deleted]")
        .when(F.col("doc_id") % 11 != 3, F.concat(F.lit("u"), "doc_id"))
        .alias("author"),
        F.concat(F.lit("t2_"), (F.col("doc_id") % 97).cast("string")).alias("author_fullname"),
        (F.lit(1500000000) + F.col("doc_id")).alias("created_utc"),
        F.concat(F.lit("RS_"), "lang").alias("source_file"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("over_18"),
        F.when(F.col("n_chars") < 40, "[Removed]").otherwise(F.substring_index("text", "\n", 1)).alias("title"),
        F.when(newline > 0, F.substr("text", newline + 1)).alias("selftext"),
        F.col("n_chars").alias("score"),
    )


COMMUNITIES = """
communities AS (
  SELECT source || '_' || lang AS display_name, '/r/' || source || '_' || lang || '/' AS url,
         source || '_' || lang AS id, 't5_' || source || '_' || lang AS name, 'About ' || source AS title,
         'Posts in ' || lang AS description,
         nullif(lang, 'es') AS lang,
         CASE lang WHEN 'fr' THEN 'private' WHEN 'de' THEN 'restricted' ELSE 'public' END AS subreddit_type,
         max(n_chars) > 19000 AS over18, count(*) AS subscribers, count(*) AS post_count
  FROM documents GROUP BY source, lang)
"""


def communities(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "lang", "source", "n_chars")
    name = F.concat("source", F.lit("_"), "lang")
    sizes = d.groupBy("source", "lang").agg(F.count("*").alias("subscribers"), F.max("n_chars").alias("longest"))
    kind = F.when(F.col("lang") == "fr", "private").when(F.col("lang") == "de", "restricted").otherwise("public")
    return sizes.select(
        name.alias("display_name"),
        F.concat(F.lit("/r/"), name, F.lit("/")).alias("url"),
        name.alias("id"),
        F.concat(F.lit("t5_"), name).alias("name"),
        F.concat(F.lit("About "), "source").alias("title"),
        F.concat(F.lit("Posts in "), "lang").alias("description"),
        F.nullif("lang", F.lit("es")).alias("lang"),
        kind.alias("subreddit_type"),
        (F.col("longest") > 19000).alias("over18"),
        "subscribers",
        F.col("subscribers").alias("post_count"),
    )


# ---- cleaned text ----------------------------------------------------------------


def sql_without_numbers(x: str) -> str:
    """Numeric-only words out. A mark after every non-word character lets
    neighbouring numbers be matched without look-around."""
    marked = f"chr(1) || regexp_replace({x} || ' ', '([^\\p{{L}}\\p{{N}}_])', '\\1' || chr(1), 'g')"
    gone = f"regexp_replace({marked}, '\\x01[0-9]+([^\\p{{L}}\\p{{N}}_])', chr(1) || ' \\1', 'g')"
    return f"regexp_replace(regexp_replace({gone}, '\\x01', '', 'g'), ' $', '')"


def sql_urls_out(x: str) -> str:
    http = f"regexp_replace({x}, 'https?://[a-zA-Z!$-_]+', ' ', 'g')"
    return f"regexp_replace({http}, 'www[a-zA-Z!$-_]+', ' ', 'g')"


def sql_entities(x: str) -> str:
    for entity, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"replace({x}, '&amp;', '&')"


def sql_punctuation_out(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_+\\x08]', ' ', 'g'), ' +', ' ', 'g')"


def sql_clean(x: str) -> str:
    x = f"replace(replace(lower({x}), chr(10), ' '), chr(9), ' ')"
    return sql_punctuation_out(sql_without_numbers(sql_entities(sql_urls_out(x))))


def sql_clean_thread(x: str) -> str:
    x = sql_without_numbers(sql_entities(sql_urls_out(x)))
    return sql_punctuation_out(f"replace({x}, '/r/', '')")


SQL_TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"

CLEAN = f"clean AS (SELECT doc_id, source, lang, {sql_clean('text')} AS clean_text FROM documents)"

TF = f"""
{CLEAN},
tf AS (SELECT doc_id, term, count(*) AS tf FROM
       (SELECT doc_id, unnest({SQL_TOKENS.format('clean_text')}) AS term FROM clean) GROUP BY doc_id, term),
freq AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM documents)
"""


def clean_documents(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "text", *extra)
    return T.clean_corpus_text(d, "text").drop("text")


# ---- sentences and threads -------------------------------------------------------

SENTENCES = """
posts AS (
  SELECT conv_id, CAST(max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS INTEGER) AS health_claim,
         CASE WHEN max(turn) = 7 THEN 2 WHEN max(turn) = 6 THEN 0 END AS send_to_mturk,
         'turns' || count(*) AS subreddit
  FROM conversations GROUP BY conv_id),
sentences AS (
  SELECT 't3_' || c.conv_id AS post_fullname, 't1_' || c.conv_id || '_' || c.turn AS comment_fullname,
         p.subreddit, CAST(least(c.turn, 7) AS INTEGER) AS sentence_location,
         CAST(generate_subscripts(string_split(c.text, chr(10)), 1) - 1 AS INTEGER) AS sentence_order,
         unnest(string_split(c.text, chr(10))) AS sentence_text, p.health_claim, p.send_to_mturk
  FROM conversations c JOIN posts p ON p.conv_id = c.conv_id)
"""


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    posts = turns.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "system", 1).otherwise(0)).alias("health_claim"),
        F.when(F.max("turn") == 7, 2).when(F.max("turn") == 6, 0).alias("send_to_mturk"),
        F.concat(F.lit("turns"), F.count("*")).alias("subreddit"),
    )
    lines = turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("sentence_order", "sentence_text"))
    return lines.join(posts, "conv_id").select(
        F.concat(F.lit("t3_"), "conv_id").alias("post_fullname"),
        F.concat(F.lit("t1_"), "conv_id", F.lit("_"), "turn").alias("comment_fullname"),
        "subreddit",
        F.least("turn", F.lit(7)).cast("int").alias("sentence_location"),
        "sentence_order",
        "sentence_text",
        "health_claim",
        "send_to_mturk",
    )


LEMMAS = """
lemmas AS (SELECT DISTINCT token, substr(token, 1, length(token) - 1) AS lemma FROM
           (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS token FROM benchmark)
           WHERE token LIKE '%s')
"""


def lemmas(spark: SparkSession, folder: str) -> DataFrame:
    """Token -> lemma for the words of the benchmark table that end in s."""
    tokens = table(spark, folder, "benchmark", "text").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return tokens.where(F.col("token").endswith("s")).select(
        "token", F.lit(None).cast("string").alias("pos"), F.expr("substr(token, 1, length(token) - 1)").alias("lemma")
    )


SENTENCE_KEY = ["post_fullname", "sentence_location", "sentence_order"]
SQL_STOPS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"

CLEAN_SENTENCES = f"""
{SENTENCES}, {LEMMAS},
cleaned AS (SELECT *, {sql_clean_thread('sentence_text')} AS clean_text FROM sentences),
pieces AS (SELECT post_fullname, sentence_location, sentence_order, unnest(w) AS word, generate_subscripts(w, 1) AS pos
           FROM (SELECT *, string_split(clean_text, ' ') AS w FROM cleaned)),
kept AS (SELECT p.post_fullname, p.sentence_location, p.sentence_order, p.pos, coalesce(l.lemma, p.word) AS word
         FROM pieces p LEFT JOIN lemmas l ON l.token = p.word
         WHERE p.word <> '' AND lower(p.word) NOT IN {SQL_STOPS}),
rejoined AS (SELECT post_fullname, sentence_location, sentence_order, string_agg(word, ' ' ORDER BY pos) AS t
             FROM kept WHERE word NOT IN {SQL_STOPS} GROUP BY ALL),
lemmatized AS (SELECT c.*, coalesce(r.t, '') AS lemmatized_text
               FROM cleaned c LEFT JOIN rejoined r USING (post_fullname, sentence_location, sentence_order))
"""


def lemmatized_sentences(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = T.clean_thread_text(sentences(spark, folder), "sentence_text")
    return words.stop_and_lemmatise(cleaned, SENTENCE_KEY, "clean_text", STOP_WORDS, lemmas(spark, folder))


PREFIX_CASE = """CASE sentence_location WHEN 0 THEN 'sss' WHEN 1 THEN 'ttt' WHEN 2 THEN 'ddd' ELSE 'ccc' END"""

LOCATIONS = f"""
{CLEAN_SENTENCES},
prefixed AS (SELECT *, array_to_string(list_transform(
                 list_filter(string_split(lemmatized_text, ' '), lambda t: t <> ''),
                 lambda t: {PREFIX_CASE} || t), ' ') AS text_w_pos FROM lemmatized),
locations AS (
  SELECT post_fullname, sentence_location AS text_location, min(health_claim) AS health_claim,
         min(send_to_mturk) AS send_to_mturk, min(subreddit) AS subreddit, min(comment_fullname) AS comment_fullname,
         string_agg(lemmatized_text, ' ' ORDER BY sentence_order) AS text,
         string_agg(text_w_pos, ' ' ORDER BY sentence_order) AS text_w_pos
  FROM prefixed GROUP BY post_fullname, sentence_location)
"""

THREADS = f"""
{LOCATIONS},
threads AS (
  SELECT post_fullname, min(health_claim) AS health_claim, min(send_to_mturk) AS send_to_mturk,
         min(subreddit) AS subreddit, string_agg(text, ' ' ORDER BY text_location) AS text,
         string_agg(text_w_pos, ' ' ORDER BY text_location) AS text_w_pos
  FROM locations GROUP BY post_fullname),
labelled AS (SELECT post_fullname, CASE WHEN send_to_mturk = 2 THEN 1 ELSE health_claim END AS health_claim,
                    send_to_mturk, subreddit, text, text_w_pos FROM threads)
"""


def locations(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.combine_sentences(lemmatized_sentences(spark, folder))


def threads(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.combine_threads(locations(spark, folder))


# ---- labelled documents, fixed cluster labels, fixed predictions -----------------

LABELLED_DOCS = "labelled_docs AS (SELECT d.doc_id, d.text, l.toxic AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def labelled_docs(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "text")
    marks = table(spark, folder, "labels", "doc_id", "toxic").withColumnRenamed("toxic", "y")
    return d.join(marks, "doc_id")


CLUSTERS = """
base AS (SELECT doc_id, n_chars, CAST(substr(source, 4) AS INTEGER) AS s,
                CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS l FROM documents),
clusters AS (
  SELECT doc_id, 'kmeans' AS method, 20 AS k, 2 AS min_df, 0.6::DOUBLE AS max_df, s AS cluster FROM base
  UNION ALL SELECT doc_id, 'kmeans', 10, 2, 0.6, CAST(s // 2 AS INTEGER) FROM base
  UNION ALL SELECT doc_id, 'kmeans', 4, 7, 0.6, l FROM base
  UNION ALL SELECT doc_id, 'lda', 5, 2, 0.6, CAST(least(n_chars // 1000, 4) AS INTEGER) FROM base
  UNION ALL SELECT doc_id, 'lda', 8, 3, 0.6, l * 2 + CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END FROM base),
seeds AS (SELECT doc_id FROM labels WHERE toxic = 1)
"""


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Five fixed label columns per document, as the models' labels would come."""
    d = table(spark, folder, "documents", "doc_id", "source", "lang", "n_chars")
    s = F.expr("substr(source, 4)").cast("int")
    lang = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3)
    size = F.least(F.expr("n_chars div 1000"), F.lit(4)).cast("int")
    models = [
        ("kmeans", 20, 2, s),
        ("kmeans", 10, 2, F.floor(s / 2).cast("int")),
        ("kmeans", 4, 7, lang),
        ("lda", 5, 2, size),
        ("lda", 8, 3, lang * 2 + F.when(F.col("n_chars") > 1500, 1).otherwise(0)),
    ]
    rows = [
        F.struct(
            F.lit(method).alias("method"),
            F.lit(k).alias("k"),
            F.lit(min_df).alias("min_df"),
            F.lit(0.6).alias("max_df"),
            cluster.alias("cluster"),
        )
        for method, k, min_df, cluster in models
    ]
    return d.select("doc_id", F.inline(F.array(*rows)))


def seeds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels", "doc_id", "toxic").where(F.col("toxic") == 1).select("doc_id")


PREDICTIONS = f"""
{LABELLED_DOCS},
densities AS (SELECT doc_id, y, length(text) AS chars, len(t) AS total, len(list_distinct(t)) AS distinct_words
              FROM (SELECT doc_id, y, text, {SQL_TOKENS.format('text')} AS t FROM labelled_docs)),
scored AS (
  SELECT doc_id, 'density' AS classifier, y,
         (CASE WHEN total = 0 THEN 1000 ELSE distinct_words * 1000 // total END) / 1000.0 AS score FROM densities
  UNION ALL
  SELECT doc_id, 'length', y, CAST(least(chars // 10, 500) AS DOUBLE) / 500.0 FROM densities),
predictions AS (SELECT doc_id, classifier, y, CASE WHEN score >= 0.6 THEN 1 ELSE 0 END AS yhat, score FROM scored)
"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Two rule-based scores per labelled document, with many ties."""
    counted = labelled_docs(spark, folder).select("doc_id", "y", F.length("text").alias("chars"), T.tokens(F.col("text")).alias("t"))
    counted = counted.select(
        "doc_id", "y", "chars", F.size("t").alias("total"), F.size(F.array_distinct("t")).alias("distinct_words")
    )
    density = F.when(F.col("total") == 0, 1000).otherwise(F.expr("distinct_words * 1000 div nullif(total, 0)")) / 1000.0
    length = F.least(F.expr("chars div 10"), F.lit(500)) / 500.0
    rows = F.array(
        F.struct(F.lit("density").alias("classifier"), density.cast("double").alias("score")),
        F.struct(F.lit("length").alias("classifier"), length.cast("double").alias("score")),
    )
    scored = counted.select("doc_id", "y", F.inline(rows))
    yhat = F.when(F.col("score") >= 0.6, 1).otherwise(0)
    return scored.select("doc_id", "classifier", "y", yhat.alias("yhat"), "score")
