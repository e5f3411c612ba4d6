"""Queries: clusters, topics, recall and the comparison of models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from forumlens.functions import text as T
from forumlens.operators import clusters as C
from forumlens.operators import decompose, filters, lloyd, ngrams, passes, recall, topics, vocabulary
from forumlens.plans import terms
from forumlens.plans.registry import query
from forumlens.plans.views import CLUSTERS, SQL_TOKENS, TF, clusters, r6, seeds, table
from forumlens.session import written

ROUNDS, SEED = 50, 1


# ---- distances to fixed centres --------------------------------------------------

DISTANCES = """
long AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
centres AS (SELECT label AS c, dim, avg(x) AS m FROM long GROUP BY label, dim),
distances AS (SELECT l.vec_id, l.label, c.c, sqrt(sum((l.x - c.m) * (l.x - c.m))) AS d
              FROM long l JOIN centres c ON c.dim = l.dim GROUP BY l.vec_id, l.label, c.c)
"""


def with_distances(spark, folder):
    """Embeddings with their distances to the mean vector of every label."""
    e = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    centres = C.label_centres(e, "embedding", "label")
    return C.with_distances(e, "embedding", [c for _, c in centres]), [label for label, _ in centres]


@query("M2", sql=f"WITH {DISTANCES} SELECT vec_id, c AS centre, round(d, 6) AS distance FROM distances")
def centre_distances(spark, folder):
    measured, labels = with_distances(spark, folder)
    long = measured.select("vec_id", F.posexplode("distances").alias("at", "d"))
    centre = F.get(F.array(*[F.lit(x) for x in labels]), F.col("at"))
    return long.select("vec_id", centre.alias("centre"), r6("d").alias("distance"))


@query(
    "M3",
    sql=f"""WITH {DISTANCES}, nearest AS (SELECT vec_id, min(d) AS d FROM distances GROUP BY vec_id)
    SELECT CAST(10 AS INTEGER) AS k, round(sum(d * d), 4) AS inertia FROM nearest""",
)
def elbow_table(spark, folder):
    measured, labels = with_distances(spark, folder)
    total = C.inertia(measured.withColumn("k", F.lit(len(labels))), "distances", "k")
    return total.withColumn("inertia", F.round("inertia", 4))


def silhouette_sql(points: str) -> str:
    """Mean silhouette over (id, c, v) rows of `points`, from all pairs."""
    return f"""SELECT avg((b - a) / greatest(a, b)) FROM (
      SELECT id, max(d) FILTER (own) AS a, min(d) FILTER (NOT own) AS b FROM (
        SELECT x.id, x.c = y.c AS own, y.c, sum(list_cosine_distance(x.v, y.v)) / count(*) FILTER (x.id <> y.id) AS d
        FROM {points} x, {points} y GROUP BY x.id, x.c = y.c, y.c) GROUP BY id)"""


@query(
    "M4",
    sql=f"""WITH {DISTANCES},
    by_features AS (SELECT vec_id AS id, label AS c, embedding::DOUBLE[] AS v FROM embeddings),
    by_distances AS (SELECT vec_id AS id, label AS c, list(d ORDER BY c) AS v FROM distances GROUP BY vec_id, label)
    SELECT round(({silhouette_sql('by_distances')}), 6) AS on_distances, round(({silhouette_sql('by_features')}), 6) AS on_features""",
)
def cosine_silhouette(spark, folder):
    """On the distances, as in the original, and on the vectors."""
    measured, _ = with_distances(spark, folder)
    measured = written(measured, "distances")
    scores = (C.silhouette(measured, "distances", "label"), C.silhouette(measured, "embedding", "label"))
    both = spark.createDataFrame([scores], "on_distances DOUBLE, on_features DOUBLE")
    return both.select(r6("on_distances").alias("on_distances"), r6("on_features").alias("on_features"))


@query(
    "W3",
    sql="""SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS top_position,
    round(list_max(embedding)::DOUBLE, 6) AS weight FROM embeddings""",
)
def row_argmax(spark, folder):
    e = table(spark, folder, "embeddings", "vec_id", "embedding")
    return e.select(
        "vec_id",
        topics.arg_max(F.col("embedding")).alias("top_position"),
        r6(F.array_max("embedding").cast("double")).alias("weight"),
    )


@query(
    "W9",
    sql="SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS source_no FROM documents",
)
def dense_relabel(spark, folder):
    return C.dense_relabel(table(spark, folder, "documents", "doc_id", "source"), "source", "source_no").drop("source")


# ---- learned models --------------------------------------------------------------


def reduced_vectors(spark, folder, size=terms.SVD_SIZE):
    vectors, _ = terms.document_vectors(spark, folder)
    coordinates, _ = decompose.truncated_svd(vectors, "doc_id", "features", size)
    return decompose.unit_rows(coordinates, "svd")


# The numbers of clusters that are compared.
ALL_K = [15, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90, 100, 110, 120, 150]


@query("M1", "M6")
def kmeans_labels(spark, folder):
    """k-means on the reduced documents for all 16 k with ten starts each, long form."""
    labels, _ = C.kmeans_sweep(reduced_vectors(spark, folder), "doc_id", "svd", ALL_K)
    return labels


@query("M3", "M4", "M6")
def kmeans_sweep_summary(spark, folder):
    return C.kmeans_sweep(reduced_vectors(spark, folder), "doc_id", "svd", ALL_K)[1]


FIXED_K, FIXED_STEPS = [3, 5, 10], 3


def lloyd_sql() -> str:
    """Labels after some steps of k-means from the vectors of the smallest ids."""
    ks = f"(SELECT unnest({FIXED_K}) AS k)"
    parts = [
        """long AS (SELECT vec_id, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
        ranked AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM embeddings)""",
        f"s0 AS (SELECT k, c, dim, x AS m FROM ranked JOIN long USING (vec_id), {ks} WHERE c < k)",
    ]
    for i in range(FIXED_STEPS + 1):
        parts.append(f"""d{i} AS (SELECT k, vec_id, c, sum((x - m) * (x - m)) AS d FROM long JOIN s{i} USING (dim) GROUP BY ALL),
        a{i} AS (SELECT k, vec_id, arg_min(c, d) AS c, min(d) AS d FROM d{i} GROUP BY ALL)""")
        parts.append(f"""means{i} AS (SELECT k, c, dim, avg(x) AS m FROM a{i} JOIN long USING (vec_id) GROUP BY ALL),
        s{i + 1} AS (SELECT s.k, s.c, s.dim, coalesce(n.m, s.m) AS m FROM s{i} s LEFT JOIN means{i} n USING (k, c, dim))""")
    last = f"SELECT vec_id, CAST(k AS INTEGER) AS k, CAST(c AS INTEGER) AS cluster, round(sqrt(d), 6) AS distance FROM a{FIXED_STEPS}"
    return f"WITH {', '.join(parts)} {last}"


@query("M1", "M6", sql=lloyd_sql())
def kmeans_steps(spark, folder):
    """Labels after three steps from fixed centres, all models in the same passes."""
    e = table(spark, folder, "embeddings", "vec_id", "embedding")
    e = written(e.select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "vectors")
    first = np.array([r.x for r in e.orderBy("vec_id").limit(max(FIXED_K)).collect()])
    models = [lloyd.Model(k, 0, first[:k].copy()) for k in FIXED_K]
    lloyd.lloyd(passes.held_matrix(e, "x"), models, FIXED_STEPS, tolerance=-1.0)
    found = lloyd.labels(e, "vec_id", "x", models)
    return found.select("vec_id", "k", "cluster", r6("weight").alias("distance"))


def fitted_topics(spark, folder, k=5, passes=topics.STEPS):
    docs, model = terms.document_vectors(spark, folder)
    words = model.stages[0].vocabulary
    bags = docs.select("doc_id", "counts")
    return bags, words, topics.fit_lda(bags, k, "counts", passes)


@query("M7", "M8")
def topic_table(spark, folder):
    bags, words, model = fitted_topics(spark, folder)
    return topics.topic_table(model, bags, "doc_id", words)


@query("W4")
def topic_terms(spark, folder):
    _, words, model = fitted_topics(spark, folder)
    return topics.topic_terms(model, words)


@query("M9")
def topic_sweep(spark, folder):
    docs, model = terms.document_vectors(spark, folder)
    labels, lists = topics.lda_sweep(docs, "doc_id", model.stages[0].vocabulary, [3, 5], "counts")
    counts = labels.groupBy("k", "cluster").agg(F.count("*").alias("docs"))
    return lists.join(counts, ["k", "cluster"], "left").fillna(0, ["docs"])


@query(
    "M10",
    sql=f"""WITH {TF}, per AS (SELECT d.lang, tf.term, sum(tf.tf) AS n FROM tf JOIN documents d ON d.doc_id = tf.doc_id GROUP BY 1, 2),
    top AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) - 1 AS rank FROM per QUALIFY rank < 8),
    pairs AS (SELECT a.lang, a.term AS wi, b.term AS wj FROM top a JOIN top b ON a.lang = b.lang AND b.rank < a.rank),
    upper AS (SELECT p.lang, p.wi, p.wj, count(*) AS dj FROM pairs p JOIN tf ON tf.term = p.wj GROUP BY ALL),
    met AS (SELECT p.lang, p.wi, p.wj, count(*) AS both FROM pairs p JOIN tf a ON a.term = p.wi
            JOIN tf b ON b.term = p.wj AND b.doc_id = a.doc_id GROUP BY ALL)
    SELECT u.lang AS cluster, round(avg(ln((coalesce(m.both, 0) + 1.0) / u.dj)), 6) AS u_mass
    FROM upper u LEFT JOIN met m ON m.lang = u.lang AND m.wi = u.wi AND m.wj = u.wj GROUP BY u.lang""",
)
def topic_coherence(spark, folder):
    """u_mass of the most frequent words of each language, as fixed term lists."""
    docs = terms.clean_documents(spark, folder, "lang")
    tf = written(vocabulary.term_table(docs, ["doc_id", "lang"], "clean_text"), "term_table")
    per = tf.groupBy("lang", "term").agg(F.sum("tf").alias("n"))
    top = top_per_language(per)
    return topics.u_mass(tf.select("doc_id", "term"), "doc_id", top).withColumn("u_mass", r6("u_mass"))


@query(
    "M10",
    sql=f"""WITH {TF}, per AS (SELECT d.lang, tf.term, sum(tf.tf) AS n FROM tf JOIN documents d ON d.doc_id = tf.doc_id GROUP BY 1, 2),
    top AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) - 1 AS rank FROM per QUALIFY rank < 8),
    listed AS (SELECT doc_id, {SQL_TOKENS.format("clean_text")} AS w FROM clean),
    sized AS (SELECT doc_id, w, len(w) AS n, greatest(len(w) - 110, 0) AS last FROM listed WHERE len(w) > 0),
    total AS (SELECT sum(last + 1) AS windows FROM sized),
    places AS (SELECT doc_id, last, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM sized),
    held AS MATERIALIZED (SELECT DISTINCT doc_id, lang, rank, unnest(range(greatest(pos - 109, 0), least(pos, last) + 1)) AS start
             FROM places JOIN top USING (term)),
    share AS MATERIALIZED (SELECT a.lang, a.rank AS a, b.rank AS b, count(*) / max(windows)::DOUBLE AS p
              FROM held a JOIN held b USING (doc_id, lang, start), total GROUP BY 1, 2, 3),
    grid AS (SELECT x.lang, x.rank AS a, y.rank AS b, coalesce(s.p, 0) AS p, sa.p AS pa, sb.p AS pb
             FROM top x JOIN top y ON x.lang = y.lang LEFT JOIN share s ON s.lang = x.lang AND s.a = x.rank AND s.b = y.rank
             LEFT JOIN share sa ON sa.lang = x.lang AND sa.a = x.rank AND sa.b = x.rank
             LEFT JOIN share sb ON sb.lang = x.lang AND sb.a = y.rank AND sb.b = y.rank),
    vectors AS (SELECT lang, a, b, coalesce(ln((p + 1e-12) / (pa * pb)) / -ln(p + 1e-12), 0) AS v FROM grid),
    context AS (SELECT lang, b, sum(v) AS c FROM vectors GROUP BY ALL),
    cosines AS (SELECT lang, a, sum(v * c) / sqrt(sum(v * v) * sum(c * c)) AS cos FROM vectors JOIN context USING (lang, b) GROUP BY ALL)
    SELECT lang AS cluster, round(avg(cos), 6) AS c_v FROM cosines GROUP BY lang""",
)
def topic_coherence_cv(spark, folder):
    """c_v of the same term lists, over sliding windows of 110 words."""
    docs = terms.clean_documents(spark, folder, "lang")
    docs = written(docs.select("doc_id", "lang", T.tokens(F.col("clean_text")).alias("words")), "words")
    slices = ngrams.ngram_counts(docs.select("words", F.col("lang").alias("y")), 1)
    per = slices.groupBy(F.col("y").alias("lang"), "term").agg(F.sum("tf").alias("n"))
    return topics.c_v(docs, "doc_id", "words", top_per_language(per)).withColumn("c_v", r6("c_v"))


def top_per_language(per, n=8):
    """The n most frequent words per language; Spark keeps n per task before the shuffle."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    top = per.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return top.select(F.col("lang").alias("cluster"), (F.col("r") - 1).alias("rank"), "term")


@query("M16")
def layout_table(spark, folder):
    """First two SVD coordinates of every document with its class."""
    classes = table(spark, folder, "labels", "doc_id", "toxic").select(
        "doc_id", F.when(F.col("toxic") == 1, "seed").otherwise("new").alias("class")
    )
    return C.layout(reduced_vectors(spark, folder, 2), "svd", classes)


# ---- fixed labels: seeds, recall, best models ------------------------------------


@query(
    "M5",
    sql=f"""WITH {CLUSTERS} SELECT method, k, cluster, count(*) AS n_seeds FROM clusters
    WHERE doc_id IN (SELECT doc_id FROM seeds) GROUP BY method, k, cluster""",
)
def seeds_per_cluster(spark, folder):
    return C.seeds_per_cluster(clusters(spark, folder), seeds(spark, folder))


@query(
    "M6",
    sql=f"""WITH {CLUSTERS} SELECT doc_id, max(cluster) FILTER (k = 4) AS "4", max(cluster) FILTER (k = 10) AS "10",
    max(cluster) FILTER (k = 20) AS "20" FROM clusters WHERE method = 'kmeans' GROUP BY doc_id""",
)
def label_matrix(spark, folder):
    return C.label_matrix(clusters(spark, folder).where("method = 'kmeans'"), "doc_id", [4, 10, 20])


TOP = f"""{CLUSTERS},
held AS (SELECT method, k, cluster, count(*) AS n_seeds FROM clusters WHERE doc_id IN (SELECT doc_id FROM seeds) GROUP BY ALL),
top AS (SELECT method, k, cluster, row_number() OVER (PARTITION BY method, k ORDER BY n_seeds DESC, cluster) AS rank FROM held QUALIFY rank <= 3),
members AS (SELECT c.method, c.k, CAST(t.rank AS INTEGER) AS rank, c.cluster, c.doc_id AS member, c.min_df, c.max_df
            FROM clusters c JOIN top t ON t.method = c.method AND t.k = c.k AND t.cluster = c.cluster)"""

RECALL = f"""{TOP},
rounds AS (SELECT unnest(range({SEED}, {SEED + ROUNDS})) AS round),
ranked AS (SELECT s.doc_id, r.round, row_number() OVER (PARTITION BY r.round ORDER BY md5(r.round || ':' || s.doc_id), s.doc_id) AS pos
           FROM seeds s, rounds r),
split AS (SELECT doc_id, round, pos <= (SELECT count(*) // 2 FROM seeds) AS drawn FROM ranked),
counts AS (SELECT c.method, c.k, s.round, c.cluster, count(*) FILTER (s.drawn) AS n_seeds, count(*) FILTER (NOT s.drawn) AS held_out
           FROM split s JOIN clusters c ON c.doc_id = s.doc_id GROUP BY ALL),
sizes AS (SELECT method, k, cluster, count(*) AS size FROM clusters GROUP BY ALL),
best AS (SELECT c.*, z.size, CASE WHEN n_seeds > 0 THEN row_number() OVER (PARTITION BY c.method, c.k, c.round ORDER BY n_seeds DESC, c.cluster) END AS pos
         FROM counts c JOIN sizes z USING (method, k, cluster)),
per_round AS (SELECT method, k, round, CAST(n AS INTEGER) AS n,
                     round_even(sum(CASE WHEN pos <= n THEN held_out ELSE 0 END) * 10000.0::DOUBLE / sum(held_out), 0) / 10000 AS recall,
                     sum(CASE WHEN pos <= n THEN size ELSE 0 END)::BIGINT AS total
              FROM best, (SELECT unnest([1, 2, 3]) AS n) GROUP BY method, k, round, n),
recall AS (SELECT method, k, n, round_even(sum(round_even(recall * 10000, 0)) / count(*), 0) / 10000 AS average_recall,
                  round_even(sum(total) * 10000.0::DOUBLE / count(*), 0) / 10000 AS total_subs
           FROM per_round GROUP BY method, k, n)"""


@query("M11", sql=f"WITH {RECALL} SELECT method, k, CAST(round AS INTEGER) AS round, n, recall, total FROM per_round")
def recall_rounds(spark, folder):
    return recall.recall_rounds(clusters(spark, folder), seeds(spark, folder), ROUNDS, SEED)


@query("M11", "A17", sql=f"WITH {RECALL} SELECT * FROM recall")
def cluster_recall(spark, folder):
    return recall.cluster_recall(clusters(spark, folder), seeds(spark, folder), ROUNDS, SEED)


# Labels that come from the data's vectors: the nearest label mean of each embedding.
VECTOR_CLUSTERS = f"""{DISTANCES},
clusters AS (SELECT vec_id AS doc_id, 'kmeans' AS method, CAST(10 AS INTEGER) AS k, 2 AS min_df, 0.6::DOUBLE AS max_df,
             CAST(arg_min(c, round(d, 9)) AS INTEGER) AS cluster
             FROM (SELECT * FROM distances ORDER BY vec_id, c) GROUP BY vec_id),
seeds AS (SELECT doc_id FROM labels WHERE toxic = 1)
"""


def vector_clusters(spark, folder):
    measured, labels = with_distances(spark, folder)
    near = C.nearest(F.transform("distances", lambda d: F.round(d, 9)))
    return measured.select(
        F.col("vec_id").alias("doc_id"),
        F.lit("kmeans").alias("method"),
        F.lit(len(labels)).alias("k"),
        F.lit(2).alias("min_df"),
        F.lit(0.6).alias("max_df"),
        F.get(F.array(*[F.lit(int(x)) for x in labels]), near).alias("cluster"),
    )


@query("M2", "M5", "M11", "A17", sql=f"WITH {RECALL.replace(CLUSTERS, VECTOR_CLUSTERS)} SELECT * FROM recall")
def chain_from_vectors(spark, folder):
    """Labels from distances, seeds of each cluster, repeated splits, mean recall: one chain over the vectors."""
    labels = written(vector_clusters(spark, folder), "labels")
    return recall.cluster_recall(labels, seeds(spark, folder), ROUNDS, SEED)


@query("M1", "M5", "M11", "A17")
def chain_from_kmeans(spark, folder):
    """The same chain from texts: terms, TF-IDF, SVD, k-means labels, recall of the seeds."""
    labels, _ = C.kmeans_sweep(reduced_vectors(spark, folder), "doc_id", "svd", [30])
    return recall.cluster_recall(written(labels, "labels"), seeds(spark, folder), ROUNDS, SEED)


@query("M8")
def topic_seeds(spark, folder):
    """Documents and seeds of each topic."""
    bags, _, model = fitted_topics(spark, folder)
    labels = topics.dominant_topics(model, bags, "doc_id").select("doc_id", F.lit("lda").alias("method"), F.lit(5).alias("k"), "cluster")
    labels = written(labels, "labels")
    sizes = labels.groupBy("method", "k", "cluster").agg(F.count("*").alias("docs"))
    held = C.seeds_per_cluster(labels, seeds(spark, folder))
    return sizes.join(held, ["method", "k", "cluster"], "left").fillna(0, ["n_seeds"])


@query("W2", sql=f"WITH {TOP} SELECT method, k, cluster, CAST(rank AS INTEGER) AS rank FROM top")
def top_clusters(spark, folder):
    held = C.seeds_per_cluster(clusters(spark, folder), seeds(spark, folder))
    return recall.top_clusters(held, recall.MODEL).drop("n_seeds")


def recall_table(spark, folder):
    labels = clusters(spark, folder)
    params = labels.select("method", "k", "min_df", "max_df").distinct()
    scores = recall.cluster_recall(labels, seeds(spark, folder), ROUNDS, SEED).join(params, ["method", "k"])
    return written(scores, "recall")


PARAMS = "params AS (SELECT DISTINCT method, k, min_df, max_df, method || '_' || min_df || '_' || max_df || '_' || k AS key FROM clusters)"
WIDE = ", ".join(f"max(average_recall) FILTER (n = {n}) AS \"{n}_av_recall\"" for n in (1, 2, 3)) + ", " + ", ".join(
    f"max(total_subs) FILTER (n = {n}) AS \"{n}_av_subs\"" for n in (1, 2, 3)
)
SIZES = ", ".join(
    f"max(CASE WHEN rank = {n} THEN cluster END) AS \"{n}_cluster_id\", max(CASE WHEN rank = {n} THEN size END) AS \"{n}_cluster_size\""
    for n in (1, 2, 3)
)
RESULTS = f"""{RECALL}, {PARAMS},
results AS (SELECT * FROM params JOIN (SELECT method, k, {WIDE} FROM recall GROUP BY method, k) USING (method, k)
  JOIN (SELECT method, k, {SIZES} FROM (SELECT method, k, rank, cluster, count(*) AS size FROM members GROUP BY ALL)
        GROUP BY method, k) USING (method, k)),
best_models AS (SELECT key, method, k, min_df, max_df, "2_av_recall" AS recall,
  coalesce("1_cluster_size", 0) + coalesce("2_cluster_size", 0) AS total_subs FROM results
  WHERE "2_av_recall" > 0.1 AND coalesce("1_cluster_size", 0) + coalesce("2_cluster_size", 0) < 0.9 * (SELECT count(*) FROM documents)),
chosen AS (SELECT b.key, b.method, m.member FROM best_models b JOIN members m ON m.method = b.method AND m.k = b.k WHERE m.rank <= 2)"""


@query("A13", "J5", sql=f"WITH {RECALL}, {PARAMS} SELECT key, {WIDE} FROM recall JOIN params USING (method, k) GROUP BY key")
def recall_pivots(spark, folder):
    return recall.recall_matrix(recall_table(spark, folder))


@query("M12", sql=f"WITH {RESULTS} SELECT * FROM results")
def model_results(spark, folder):
    return recall.result_table(recall_table(spark, folder), clusters(spark, folder), seeds(spark, folder))


@query("M12", "O8", "O9", sql=f"WITH {TOP} SELECT method, k, rank, cluster, member FROM members")
def top_cluster_members(spark, folder):
    return recall.top_cluster_members(clusters(spark, folder), seeds(spark, folder))


@query("F14", sql=f"WITH {CLUSTERS} SELECT DISTINCT method, k, min_df, max_df FROM clusters WHERE min_df <> 7 AND max_df <> 1000")
def drop_models(spark, folder):
    return filters.drop_models(clusters(spark, folder).select("method", "k", "min_df", "max_df").distinct())


def best(spark, folder):
    limit = 0.9 * table(spark, folder, "documents", "doc_id").count()
    return recall.best_models(model_results(spark, folder), min_recall=0.1, max_subs=limit, top=2)


@query("M13", sql=f"WITH {RESULTS} SELECT * FROM best_models")
def best_models(spark, folder):
    return best(spark, folder)


def chosen_members(spark, folder):
    """The best models (one row each, written once) and their members."""
    models = written(best(spark, folder), "best_models")
    return recall.model_members(models, top_cluster_members(spark, folder), top=2), models


@query(
    "O7",
    sql=f"""WITH {RESULTS} SELECT a.key || ' vs. ' || b.key AS pair, c.member FROM best_models a JOIN best_models b ON a.key <> b.key
    JOIN chosen c ON c.key = a.key WHERE NOT EXISTS (SELECT 1 FROM chosen o WHERE o.key = b.key AND o.member = c.member)""",
)
def member_differences(spark, folder):
    return recall.compare_models(*chosen_members(spark, folder))


@query("J10", sql=f"WITH {CLUSTERS}, {PARAMS} SELECT a.key, b.key AS other FROM params a JOIN params b ON a.key < b.key")
def model_pairs(spark, folder):
    params = clusters(spark, folder).select("method", "min_df", "max_df", "k").distinct()
    return recall.model_pairs(params.select(T.model_key(*[F.col(c) for c in ("method", "min_df", "max_df", "k")]).alias("key")))


MATRIX_KEYS = ["kmeans_2_0.6_20", "kmeans_2_0.6_10", "lda_2_0.6_5", "lda_3_0.6_8"]


@query(
    "A15",
    sql=f"WITH {RESULTS} SELECT member, "
    + ", ".join(f"CAST(count(*) FILTER (key = '{k}') > 0 AS INTEGER) AS \"{k}\"" for k in MATRIX_KEYS)
    + " FROM chosen GROUP BY member",
)
def member_matrix(spark, folder):
    return recall.member_matrix(chosen_members(spark, folder)[0], MATRIX_KEYS)


@query(
    "A16",
    sql=f"""WITH {RESULTS} SELECT member, round(100.0::DOUBLE * count(DISTINCT key) / (SELECT count(DISTINCT key) FROM chosen), 6) AS share
    FROM chosen GROUP BY member""",
)
def member_share(spark, folder):
    return recall.member_share(*chosen_members(spark, folder), "share").withColumn("share", r6("share"))


def share_sql(method: str | None) -> str:
    mine = "" if method is None else f"WHERE method = '{method}'"
    test = "true" if method is None else f"method = '{method}'"
    return (
        f"round(100.0::DOUBLE * nullif(count(DISTINCT key) FILTER ({test}), 0) / (SELECT count(DISTINCT key) FROM chosen {mine}), 6)"
    )


SHARES = f"""{RESULTS}, shares AS (SELECT member, {share_sql('kmeans')} AS kmeans, {share_sql('lda')} AS lda,
  {share_sql(None)} AS "kmeans+lda" FROM chosen GROUP BY member)"""


@query("M14", "J5", sql=f"WITH {SHARES} SELECT * FROM shares")
def member_shares(spark, folder):
    s = recall.member_shares(*chosen_members(spark, folder))
    return s.select("member", *[r6(F.col(f"`{c}`")).alias(c) for c in s.columns[1:]])


@query(
    "J12",
    "M14",
    sql=f"""WITH {SHARES} SELECT d.doc_id, coalesce(s.kmeans, 0) AS kmeans, coalesce(s.lda, 0) AS lda,
    coalesce(s."kmeans+lda", 0) AS "kmeans+lda" FROM documents d LEFT JOIN shares s ON s.member = d.doc_id""",
)
def shares_of_all_documents(spark, folder):
    return recall.shares_of_all(table(spark, folder, "documents", "doc_id"), member_shares(spark, folder))


@query(
    "M17",
    sql=f"""WITH {SHARES} SELECT d.doc_id, CAST(round_even(coalesce(s.lda, 0), 0) AS INTEGER) AS lda
    FROM documents d LEFT JOIN shares s ON s.member = d.doc_id""",
)
def percentage_layer(spark, folder):
    shares = member_shares(spark, folder).withColumnRenamed("member", "doc_id")
    return C.percentage_layer(table(spark, folder, "documents", "doc_id"), shares, "lda")


@query(
    "M15",
    sql=f"""WITH {TOP} SELECT m.member AS doc_id, m.cluster, CASE WHEN s.doc_id IS NULL THEN 0 ELSE 1 END AS seed
    FROM members m LEFT JOIN seeds s ON s.doc_id = m.member WHERE m.method = 'kmeans' AND m.k = 10 AND m.rank = 1""",
)
def new_members(spark, folder):
    return C.new_members(clusters(spark, folder), seeds(spark, folder), "kmeans", 10)
