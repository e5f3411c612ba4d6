"""Queries: sources, filters, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.functions.keys import LOCATIONS, location_prefix
from forumlens.operators import corpus, filters, ranking
from forumlens.plans.registry import query
from forumlens.plans.views import COMMUNITIES, SENTENCES, SUBMISSIONS, communities, sentences, submissions, table
from forumlens.session import new_path
from forumlens.sources import summaries, tables
from forumlens.sources.dumps import nested_field


@query("S2", sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def nested_json_field(spark, folder):
    e = table(spark, folder, "events", "event_id", "props")
    return e.select("event_id", nested_field(F.col("props"), "$.k").cast("bigint").alias("k"))


@query("S4", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def table_scan_with_predicate(spark, folder):
    return spark.read.parquet(f"{folder}/orders.parquet").where(F.col("o_totalprice") > 100000).select("o_orderkey", "o_totalprice")


@query("S7", sql="SELECT doc_id, length(text) AS chars FROM documents")
def nul_scrub(spark, folder):
    """NULs put after every line are gone again after the scrub."""
    d = table(spark, folder, "documents", "doc_id", "text")
    dirty = d.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\0")))
    return tables.scrub_nul(dirty).select("doc_id", F.length("text").cast("bigint").alias("chars"))


@query("S8", sql="SELECT 't3_' || doc_id AS fullname, source AS subreddit, 'lang=' || lang AS source_file FROM documents")
def concatenated_files(spark, folder):
    """One folder of files for each language, read as one table with the folder each row came from."""
    d = table(spark, folder, "documents", "doc_id", "source", "lang")
    keys = d.select(filters.fullname(F.col("doc_id").cast("string")).alias("fullname"), F.col("source").alias("subreddit"), "lang")
    path = new_path(spark, "dumps")
    keys.write.partitionBy("lang").parquet(path)
    back = spark.read.schema("fullname STRING, subreddit STRING, lang STRING").parquet(path)
    folder_of = F.regexp_extract(F.col("_metadata.file_path"), "/(lang=[^/]*)/", 1)
    return back.select("fullname", "subreddit", folder_of.alias("source_file"))


@query("S9", sql="SELECT 'documents.parquet' AS source_file, count(*) AS n FROM documents")
def source_file_column(spark, folder):
    d = tables.with_source_file(spark.read.parquet(f"{folder}/documents.parquet"))
    return d.groupBy("source_file").agg(F.count("*").alias("n"))


@query(
    "S11",
    sql="""SELECT lang, metric, CAST(value AS DOUBLE) AS value FROM (
    SELECT lang, 'n_docs' AS metric, count(*) AS value FROM documents GROUP BY lang
    UNION ALL SELECT lang, 'n_sources', count(DISTINCT source) FROM documents GROUP BY lang
    UNION ALL SELECT lang, 'n_chars', sum(n_chars) FROM documents GROUP BY lang)""",
)
def run_summary_long(spark, folder):
    d = table(spark, folder, "documents", "lang", "source", "n_chars")
    wide = d.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_sources"), F.sum("n_chars").alias("n_chars")
    )
    return summaries.long_metrics(wide, ["lang"], ["n_docs", "n_sources", "n_chars"])


@query(
    "S11",
    sql="""SELECT 'documents' AS corpus, '[' || string_agg('{"lang":"' || lang || '","metrics":{"n_chars":' || chars || '.0,"n_docs":' || docs
    || '.0,"n_sources":' || sources || '.0}}', ',' ORDER BY lang) || ']' AS models
    FROM (SELECT lang, sum(n_chars) AS chars, count(*) AS docs, count(DISTINCT source) AS sources FROM documents GROUP BY lang)""",
)
def run_summary_json(spark, folder):
    return summaries.nested_summary(
        run_summary_long(spark, folder).withColumn("corpus", F.lit("documents")), ["corpus"], ["lang"]
    )


@query(
    "S11",
    sql="""SELECT lang, metric, value FROM (
    SELECT lang, 'n_docs' AS metric, count(*)::DOUBLE AS value FROM documents WHERE lang <> 'fr' GROUP BY lang
    UNION ALL SELECT 'fr', 'n_docs', count(*)::DOUBLE FROM documents WHERE lang = 'fr'
    UNION ALL SELECT 'fr', 'n_sources', count(DISTINCT source)::DOUBLE FROM documents WHERE lang = 'fr')""",
)
def run_summary_merged(spark, folder):
    """The summary of one more model put into an existing one: its metrics replace those of the same name."""
    d = table(spark, folder, "documents", "lang", "source")
    old = summaries.long_metrics(d.groupBy("lang").agg(F.count("*").alias("n_docs")), ["lang"], ["n_docs"])
    again = d.where(F.col("lang") == "fr").groupBy("lang")
    new = again.agg(F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_sources"))
    return summaries.merged(old, summaries.long_metrics(new, ["lang"], ["n_docs", "n_sources"]), ["lang"])


@query(
    "F1",
    "F2",
    sql=f"""WITH {COMMUNITIES} SELECT id, name, display_name, title, url, subscribers, subreddit_type, description, lang FROM communities
    WHERE NOT over18 AND (lang = 'en' OR lang IS NULL) AND subreddit_type IN ('public', 'restricted') AND subscribers > 9""",
)
def community_filter(spark, folder):
    return filters.filter_communities(communities(spark, folder))


SUBMISSION_WHERE = """author IS DISTINCT FROM '[deleted]' AND NOT over_18
  AND coalesce(lower(title), '') NOT IN ('[deleted by user]', '[removed by user]', '[deleted]', '[removed]', '(removed)', 'removed', 'deleted')
  AND coalesce(lower(selftext), '') NOT IN ('[deleted]', '[removed]', 'deleted', 'removed')"""

ELIGIBLE = """eligible AS (SELECT display_name FROM communities WHERE NOT over18 AND (lang = 'en' OR lang IS NULL)
  AND subreddit_type IN ('public', 'restricted') AND subscribers > 9)"""

SUBMISSION_COLUMNS = (
    "subreddit_id, subreddit, id, fullname, permalink, score, title, selftext, url, author, author_fullname, created_utc, source_file"
)


@query(
    "F3",
    "F6",
    "F7",
    sql=f"""WITH {SUBMISSIONS}, {COMMUNITIES}, {ELIGIBLE} SELECT {SUBMISSION_COLUMNS} FROM submissions
    WHERE {SUBMISSION_WHERE} AND subreddit IN (SELECT display_name FROM eligible)""",
)
def submission_filter(spark, folder):
    return filters.filter_submissions(submissions(spark, folder), community_filter(spark, folder))


COMMENTS = """
comments AS (SELECT 't3_' || conv_id AS link_id,
    CASE WHEN turn <= 1 THEN 't3_' || conv_id ELSE 't1_' || conv_id || '_' || (turn - 1) END AS parent_id,
    conv_id || '_' || turn AS id, role AS subreddit, 't5_' || role AS subreddit_id, '/r/' || role || '/' || conv_id AS permalink,
    turn AS score, 'RC_' || role AS source_file,
    CASE WHEN length(text) < 60 THEN '(Removed)' ELSE text END AS body FROM conversations)
"""


COMMENT_COLUMNS = "subreddit_id, subreddit, link_id, id, parent_id, permalink, score, body, source_file"
COMMENT_WHERE = """parent_id = link_id
    AND coalesce(lower(body), '') NOT IN ('[deleted by user]', '[removed]', '(removed)', '[deleted]', 'deleted', 'removed')"""


def comments(spark, folder):
    c = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    link = F.concat(F.lit("t3_"), "conv_id")
    parent = F.concat(F.lit("t1_"), "conv_id", F.lit("_"), (F.col("turn") - 1).cast("string"))
    return c.select(
        link.alias("link_id"),
        F.when(F.col("turn") <= 1, link).otherwise(parent).alias("parent_id"),
        F.concat("conv_id", F.lit("_"), "turn").alias("id"),
        F.col("role").alias("subreddit"),
        F.concat(F.lit("t5_"), "role").alias("subreddit_id"),
        F.concat(F.lit("/r/"), "role", F.lit("/"), "conv_id").alias("permalink"),
        F.col("turn").alias("score"),
        F.concat(F.lit("RC_"), "role").alias("source_file"),
        F.when(F.length("text") < 60, "(Removed)").otherwise(F.col("text")).alias("body"),
    )


@query(
    "F4",
    "F5",
    "F6",
    sql=f"""WITH {SUBMISSIONS}, {COMMENTS} SELECT {COMMENT_COLUMNS} FROM comments
    WHERE {COMMENT_WHERE} AND link_id IN (SELECT fullname FROM submissions WHERE {SUBMISSION_WHERE})""",
)
def comment_filter(spark, folder):
    kept = submissions(spark, folder).where(filters.submission_rules())
    return filters.filter_comments(comments(spark, folder), kept)


@query(
    "C10",
    sql=f"""WITH {SUBMISSIONS}, found AS (SELECT subreddit FROM submissions WHERE over_18 GROUP BY subreddit)
    SELECT {SUBMISSION_COLUMNS} FROM submissions WHERE {SUBMISSION_WHERE} AND subreddit IN (SELECT subreddit FROM found)""",
)
def found_community_submissions(spark, folder):
    """The submission filter keyed on communities found by another step."""
    posts = submissions(spark, folder)
    found = posts.where("over_18").select(F.col("subreddit").alias("display_name")).distinct()
    return filters.filter_submissions(posts, found)


@query(
    "C10",
    sql=f"""WITH {SUBMISSIONS}, {COMMENTS}, found AS (SELECT subreddit FROM submissions WHERE over_18 GROUP BY subreddit)
    SELECT {COMMENT_COLUMNS} FROM comments WHERE {COMMENT_WHERE} AND link_id IN (
        SELECT fullname FROM submissions WHERE {SUBMISSION_WHERE} AND subreddit IN (SELECT subreddit FROM found))""",
)
def found_community_comments(spark, folder):
    """The comment filter keyed on the submissions of the found communities."""
    return filters.filter_comments(comments(spark, folder), found_community_submissions(spark, folder))


@query(
    "F8",
    sql="SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error')",
)
def membership_filter(spark, folder):
    e = table(spark, folder, "events", "event_id", "user_id", "event_type")
    return filters.members(e.select("event_id", "user_id"), "user_id", e.where(F.col("event_type") == "error"))


@query("F9", sql="SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_membership_filter(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "lang")
    return filters.non_members(d, "doc_id", table(spark, folder, "labels", "doc_id"))


@query("F10", sql="SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'click')")
def fixed_exclusion(spark, folder):
    e = table(spark, folder, "events", "event_id", "event_type")
    return e.where(~F.col("event_type").isin("error", "click"))


@query(
    "F11",
    sql="""SELECT d.source, sum(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS positive,
    sum(CASE WHEN l.toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS negative
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source""",
)
def label_selects(spark, folder):
    d, marks = table(spark, folder, "documents", "doc_id", "source"), table(spark, folder, "labels", "doc_id", "toxic")
    return d.join(marks, "doc_id").groupBy("source").agg(
        F.count_if(F.col("toxic") == 1).alias("positive"), F.count_if(F.col("toxic") == 0).alias("negative")
    )


@query(
    "F12",
    sql=f"""WITH {SENTENCES} SELECT DISTINCT post_fullname, send_to_mturk,
    CASE WHEN send_to_mturk = 2 THEN 1 ELSE health_claim END AS health_claim FROM sentences""",
)
def label_override(spark, folder):
    s = sentences(spark, folder).select("post_fullname", "send_to_mturk", "health_claim").distinct()
    return filters.override_label(s)


@query(
    "F13",
    sql=f"""WITH {SENTENCES} SELECT post_fullname, sentence_location, sentence_order, send_to_mturk FROM sentences
    WHERE send_to_mturk IS NULL OR send_to_mturk <> 2""",
)
def drop_test_questions(spark, folder):
    s = sentences(spark, folder).select("post_fullname", "sentence_location", "sentence_order", "send_to_mturk")
    return filters.without_test_questions(s)


@query(
    "F16",
    sql="SELECT o_orderkey AS order_id, o_orderpriority AS priority, o_custkey AS customer_id FROM orders",
)
def project_and_rename(spark, folder):
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer_id")
    )


@query(
    "F17",
    sql="""SELECT d.doc_id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def fill_nulls(spark, folder):
    d = table(spark, folder, "documents", "doc_id")
    return d.join(table(spark, folder, "labels", "doc_id", "quality"), "doc_id", "left").fillna(0, subset=["quality"])


@query(
    "F18",
    sql="SELECT CAST(doc_id AS VARCHAR) AS doc_key, CAST(n_chars > 1000 AS INTEGER) AS is_long, TRY_CAST(substr(source, 4) AS BIGINT) AS source_no FROM documents",
)
def casts(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "n_chars", "source")
    return d.select(
        F.col("doc_id").cast("string").alias("doc_key"),
        (F.col("n_chars") > 1000).cast("int").alias("is_long"),
        F.substr("source", F.lit(4)).try_cast("bigint").alias("source_no"),
    )


@query("F19", sql="SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events")
def surrogate_row_index(spark, folder):
    return ranking.row_index(table(spark, folder, "events", "event_id"), "event_id")


@query(
    "F20",
    sql="""SELECT lang, 'n_docs' AS measure, count(*) AS value FROM documents GROUP BY lang
    UNION ALL SELECT lang, 'longest', max(n_chars) FROM documents GROUP BY lang""",
)
def wide_to_long(spark, folder):
    d = table(spark, folder, "documents", "lang", "n_chars")
    wide = d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.max("n_chars").alias("longest"))
    return filters.wide_to_long(wide, ["lang"], ["n_docs", "longest"], "measure", "value")


@query(
    "F20",
    sql="""SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr,
    count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source""",
)
def long_to_wide(spark, folder):
    counts = table(spark, folder, "documents", "source", "lang").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return filters.long_to_wide(counts, ["source"], "lang", ["en", "fr", "de", "es"], "n").fillna(0)


@query("J1", "J3", sql="""SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def left_join_on_key(spark, folder):
    d = table(spark, folder, "documents", "doc_id")
    return d.join(table(spark, folder, "labels", "doc_id", "quality", "toxic"), "doc_id", "left")


@query(
    "J2",
    sql="""WITH firsts AS (SELECT l_orderkey, l_suppkey, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_suppkey)
    SELECT l.l_orderkey, l.l_suppkey, l.l_linenumber, f.q FROM lineitem l
    LEFT JOIN firsts f ON f.l_orderkey = l.l_orderkey AND f.l_suppkey = l.l_suppkey""",
)
def left_join_on_two_keys(spark, folder):
    li = table(spark, folder, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    firsts = li.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("q"))
    return li.drop("l_quantity").join(firsts, ["l_orderkey", "l_suppkey"], "left")


@query(
    "J4",
    sql="SELECT c.c_custkey, n.n_name, c.c_acctbal FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey",
)
def inner_join_renamed_keys(spark, folder):
    c = table(spark, folder, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, folder, "nation", "n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name", "c_acctbal")


@query(
    "J5",
    sql="""WITH b AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey)
    SELECT coalesce(a.doc_id, b.o_custkey) AS doc_id, a.n_chars, b.n_orders FROM documents a FULL JOIN b ON a.doc_id = b.o_custkey""",
)
def full_outer_join(spark, folder):
    """Keys of either side only are among both tables."""
    orders = table(spark, folder, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").alias("n_orders"))
    return table(spark, folder, "documents", "doc_id", "n_chars").join(orders, "doc_id", "full")


@query(
    "J6",
    "O6",
    sql="""SELECT d.doc_id, d.source, e.label AS cluster FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def key_join_for_positions(spark, folder):
    """Model output meets its documents by key, never by row position."""
    d = table(spark, folder, "documents", "doc_id", "source")
    e = table(spark, folder, "embeddings", "vec_id", "label")
    return d.join(e, d.doc_id == e.vec_id).select("doc_id", "source", F.col("label").alias("cluster"))


@query(
    "J7",
    sql="""SELECT p_partkey, p_name FROM part WHERE lower(p_type) IN (SELECT lower(upper(p_type)) FROM part WHERE p_size > 45)""",
)
def case_insensitive_join(spark, folder):
    p = table(spark, folder, "part", "p_partkey", "p_name", "p_type", "p_size")
    shouted = p.where(F.col("p_size") > 45).select(F.upper("p_type").alias("kind")).distinct()
    return filters.members_ignoring_case(p, "p_type", shouted, "kind").select("p_partkey", "p_name")


@query(
    "J8",
    sql="SELECT conv_id, turn, CASE least(turn, 7) WHEN 0 THEN 'sss' WHEN 1 THEN 'ttt' WHEN 2 THEN 'ddd' ELSE 'ccc' END AS prefix, "
    + "CASE least(turn, 7) "
    + " ".join(f"WHEN {n} THEN '{name}'" for n, name, _ in LOCATIONS)
    + " END AS location FROM conversations",
)
def dictionary_lookup(spark, folder):
    c = table(spark, folder, "conversations", "conv_id", "turn")
    code = F.least("turn", F.lit(7)).cast("int")
    names = {number: name for number, name, _ in LOCATIONS}
    return c.select("conv_id", "turn", location_prefix(code).alias("prefix"), filters.lookup(code, names).alias("location"))


@query(
    "J11",
    sql="""SELECT m AS min_df, 0.6::DOUBLE AS max_df, k, count(*) FILTER (n_chars >= m * k) AS docs
    FROM documents, (SELECT unnest([2, 10, 20]) AS m), (SELECT unnest([15, 30]) AS k) GROUP BY m, k""",
)
def parameter_grid(spark, folder):
    """Documents of at least min_df * k characters, for every grid point."""
    lengths = table(spark, folder, "documents", "n_chars").groupBy("n_chars").agg(F.count("*").alias("n"))
    grid = filters.parameter_grid(spark, min_df=[2, 10, 20], max_df=[0.6], k=[15, 30])
    points = grid.select(F.collect_list(F.struct("*"))).scalar()
    met = lengths.select("n_chars", "n", F.inline(points))
    hit = F.col("n_chars") >= F.col("min_df") * F.col("k")
    return met.groupBy("min_df", "max_df", "k").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("docs"))


@query(
    "J12",
    sql="""WITH shares AS (SELECT doc_id, 100.0 * count(*) / 5 AS pct FROM labels GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(s.pct, 0) AS DOUBLE) AS pct FROM documents d LEFT JOIN shares s ON s.doc_id = d.doc_id""",
)
def left_join_and_fill(spark, folder):
    shares = table(spark, folder, "labels", "doc_id").groupBy("doc_id").agg((F.lit(100.0) * F.count("*") / 5).alias("pct"))
    return table(spark, folder, "documents", "doc_id").join(shares, "doc_id", "left").fillna(0.0, subset=["pct"])


@query(
    "O1",
    sql="""SELECT o_orderstatus, o_orderpriority, o_custkey, o_orderkey FROM orders
    ORDER BY o_orderstatus, o_orderpriority, o_custkey, o_orderkey""",
)
def multi_key_sort(spark, folder):
    keys = ["o_orderstatus", "o_orderpriority", "o_custkey", "o_orderkey"]
    return table(spark, folder, "orders", *keys).orderBy(*keys)


@query(
    "O2",
    sql="""SELECT p_size, p_retailprice, p_brand, p_partkey FROM part
    ORDER BY p_size DESC, p_retailprice DESC, p_brand DESC, p_partkey""",
)
def mixed_direction_sort(spark, folder):
    p = table(spark, folder, "part", "p_size", "p_retailprice", "p_brand", "p_partkey")
    return p.orderBy(F.desc("p_size"), F.desc("p_retailprice"), F.desc("p_brand"), "p_partkey")


@query("O3", sql="SELECT s_name, s_acctbal FROM supplier ORDER BY s_acctbal, s_name")
def single_key_sort(spark, folder):
    return table(spark, folder, "supplier", "s_name", "s_acctbal").orderBy("s_acctbal", "s_name")


@query(
    "O4",
    sql="""SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0
    UNION SELECT doc_id FROM documents WHERE lang = 'es' UNION SELECT doc_id FROM documents WHERE n_chars < 100""",
)
def union_of_votes(spark, folder):
    marks, d = table(spark, folder, "labels"), table(spark, folder, "documents", "doc_id", "lang", "n_chars")
    return filters.union_distinct(
        marks.where("toxic = 1").select("doc_id"),
        marks.where("quality = 0").select("doc_id"),
        d.where("lang = 'es'").select("doc_id"),
        d.where("n_chars < 100").select("doc_id"),
    )


@query(
    "O5",
    sql="""SELECT doc_id AS id, lang, NULL::INTEGER AS toxic FROM documents
    UNION ALL SELECT doc_id, NULL, toxic FROM labels""",
)
def concat_rows(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "lang").withColumnRenamed("doc_id", "id")
    return filters.concat_rows(d, table(spark, folder, "labels", "doc_id", "toxic").withColumnRenamed("doc_id", "id"))


@query(
    "A3",
    sql="SELECT source, lang, count(*) AS count FROM documents GROUP BY source, lang ORDER BY count DESC, source, lang",
)
def value_counts(spark, folder):
    return corpus.value_counts(table(spark, folder, "documents", "source", "lang"), "source", "lang")


@query(
    "A12",
    sql="""SELECT c_mktsegment, c_nationkey, c_acctbal, c_custkey FROM (
      SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal, c_custkey) AS r FROM customer) WHERE r = 1""",
)
def dedupe_keep_first(spark, folder):
    c = table(spark, folder, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return ranking.first_per_key(c, ["c_mktsegment", "c_nationkey"], ["c_acctbal", "c_custkey"])
