"""Queries: splits, classifiers, metrics and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.functions import text as T
from forumlens.operators import classify, scoring
from forumlens.plans.registry import query
from forumlens.plans.views import (
    LABELLED_DOCS,
    PREDICTIONS,
    SQL_TOKENS,
    THREADS,
    labelled_docs,
    predictions,
    r6,
    table,
    threads,
)
from forumlens.session import written

SEED = classify.SEED
LIMIT = 1000

RANKED = f"""ranked AS (SELECT doc_id, toxic AS y, count(*) OVER (PARTITION BY toxic) AS n,
  row_number() OVER (PARTITION BY toxic ORDER BY md5('{SEED}:' || doc_id), doc_id) AS r FROM labels)"""


def marks(spark, folder):
    return table(spark, folder, "labels", "doc_id", "toxic").withColumnRenamed("toxic", "y")


@query("K1", sql=f"WITH {RANKED} SELECT doc_id, y, r <= round_even(n * 0.15::DOUBLE, 0) AS hold_out FROM ranked")
def hold_out_split(spark, folder):
    return classify.hold_out_split(marks(spark, folder))


@query(
    "K2",
    sql=f"""WITH {THREADS}, ranked AS (SELECT post_fullname, health_claim, send_to_mturk,
      count(*) OVER (PARTITION BY health_claim) AS n,
      row_number() OVER (PARTITION BY health_claim ORDER BY md5('{SEED}:' || post_fullname), post_fullname) AS r
      FROM labelled WHERE send_to_mturk IS NULL OR send_to_mturk <> 2)
    SELECT post_fullname, health_claim, false AS is_test_question FROM ranked WHERE r <= round_even(n * 0.15::DOUBLE, 0)
    UNION ALL SELECT post_fullname, health_claim, true FROM labelled WHERE send_to_mturk = 2""",
)
def hold_out_with_test_questions(spark, folder):
    all_threads = threads(spark, folder).select("post_fullname", "health_claim", "send_to_mturk")
    return classify.hold_out_with_questions(all_threads)


@query("K3", sql=f"WITH {RANKED} SELECT doc_id, y, CAST((r - 1) % 5 AS INTEGER) AS fold FROM ranked")
def stratified_folds(spark, folder):
    return classify.with_folds(marks(spark, folder))


@query(
    "K12",
    sql="""SELECT doc_id, toxic AS y, round(count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY toxic)), 6) AS weight FROM labels""",
)
def balanced_weights(spark, folder):
    return classify.balanced_weights(marks(spark, folder)).withColumn("weight", r6("weight"))


@query(
    "K13",
    sql="""SELECT toxic AS y, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM labels), 6) AS prior,
    CAST(toxic = (SELECT toxic FROM labels GROUP BY toxic ORDER BY count(*) DESC, toxic LIMIT 1) AS INTEGER) AS predicted
    FROM labels GROUP BY toxic""",
)
def majority_baseline(spark, folder):
    return classify.majority_baseline(marks(spark, folder)).withColumn("prior", r6("prior"))


# ---- metrics on fixed predictions ------------------------------------------------

CELLS = f"""{PREDICTIONS},
cells AS (SELECT classifier, count(*) FILTER (y = 0 AND yhat = 0) AS tn, count(*) FILTER (y = 0 AND yhat = 1) AS fp,
                 count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 1 AND yhat = 1) AS tp
          FROM predictions GROUP BY classifier),
rates AS (SELECT *, (tn + fp + fn + tp)::DOUBLE AS n, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
                 coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS tnr FROM cells)"""


@query(
    "K14",
    "K15",
    "K16",
    "K17",
    sql=f"""WITH {CELLS} SELECT classifier, tn, fp, fn, tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, round((tp + tn) / n, 6) AS accuracy,
    round((recall + tnr) / 2, 6) AS average_recall,
    round(recall * precision + (1 - recall) * (tp + fn) / n, 6) AS weighted_average_precision,
    round((recall + tnr) / 2, 6) AS roc_auc FROM rates""",
)
def hard_label_metrics(spark, folder):
    m = scoring.metrics_from_cells(scoring.cells(predictions(spark, folder), "classifier"))
    return m.withColumns({c: r6(c) for c in scoring.METRICS})


@query(
    "K18",
    sql=f"""WITH {CELLS}, per AS (
      SELECT classifier, '0' AS label, coalesce(tn / nullif(tn + fn, 0)::DOUBLE, 0) AS p, tnr AS r,
             coalesce(2 * tn / nullif(2 * tn + fn + fp, 0)::DOUBLE, 0) AS f, tn + fp AS support FROM rates
      UNION ALL SELECT classifier, '1', precision, recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), tp + fn FROM rates),
    report AS (SELECT * FROM per
      UNION ALL SELECT classifier, 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM per GROUP BY classifier
      UNION ALL SELECT classifier, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                       sum(f * support) / sum(support), sum(support) FROM per GROUP BY classifier)
    SELECT classifier, label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support::BIGINT AS support FROM report""",
)
def classification_report(spark, folder):
    report = scoring.classification_report(predictions(spark, folder), "classifier")
    return report.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(
    "K19",
    sql=f"""WITH {CELLS}, grid AS (
      SELECT classifier, 0 AS y, 0 AS yhat, 'tn' AS cell, tn AS n, tn + fp AS total FROM cells
      UNION ALL SELECT classifier, 0, 1, 'fp', fp, tn + fp FROM cells
      UNION ALL SELECT classifier, 1, 0, 'fn', fn, fn + tp FROM cells
      UNION ALL SELECT classifier, 1, 1, 'tp', tp, fn + tp FROM cells)
    SELECT classifier, y, yhat, cell, n, coalesce(round_even(n * 100.0::DOUBLE / nullif(total, 0), 0) / 100, 0) AS normalised FROM grid""",
)
def confusion_matrix(spark, folder):
    return scoring.confusion_matrix(predictions(spark, folder), "classifier")


CURVE = f"""{CELLS},
steps AS (SELECT classifier, score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM predictions GROUP BY classifier, score),
curve AS (SELECT classifier, score, pos, neg, sum(pos) OVER w::BIGINT AS tp, sum(neg) OVER w::BIGINT AS fp,
                 sum(pos) OVER (PARTITION BY classifier) AS n_pos, sum(neg) OVER (PARTITION BY classifier) AS n_neg
          FROM steps WINDOW w AS (PARTITION BY classifier ORDER BY score DESC))""".replace(
    "sum(pos) OVER w::BIGINT", "CAST(sum(pos) OVER w AS BIGINT)"
).replace("sum(neg) OVER w::BIGINT", "CAST(sum(neg) OVER w AS BIGINT)")


@query("W8", sql=f"WITH {CURVE} SELECT classifier, score, tp, fp FROM curve")
def threshold_counts(spark, folder):
    counts = scoring.score_counts(predictions(spark, folder))
    return scoring.threshold_counts(counts).select("classifier", "score", "tp", "fp")


@query(
    "K20",
    sql=f"""WITH {CURVE}, points AS (
      SELECT classifier, score, fp / n_neg::DOUBLE AS fpr, tp / n_pos::DOUBLE AS tpr FROM curve
      UNION ALL SELECT DISTINCT classifier, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM curve),
    areas AS (SELECT classifier, sum(neg * (tp - pos / 2.0::DOUBLE)) / max(n_pos) / max(n_neg) AS auc FROM curve GROUP BY classifier)
    SELECT p.classifier, p.score, round(p.fpr, 6) AS fpr, round(p.tpr, 6) AS tpr, round(a.auc, 6) AS auc_score,
           round((r.recall + r.tnr) / 2, 6) AS auc_hard
    FROM points p JOIN areas a ON a.classifier = p.classifier JOIN rates r ON r.classifier = p.classifier""",
)
def roc_curve(spark, folder):
    return scoring.roc_curve(predictions(spark, folder)).withColumns({c: r6(c) for c in ("fpr", "tpr", "auc_score", "auc_hard")})


@query(
    "K21",
    sql=f"""WITH {CURVE}, points AS (
      SELECT classifier, score, tp / (tp + fp)::DOUBLE AS precision, tp / n_pos::DOUBLE AS recall, n_pos / (n_pos + n_neg)::DOUBLE AS baseline FROM curve
      UNION ALL SELECT DISTINCT classifier, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, n_pos / (n_pos + n_neg)::DOUBLE FROM curve)
    SELECT classifier, score, round(precision, 6) AS precision, round(recall, 6) AS recall, round(baseline, 6) AS baseline FROM points""",
)
def precision_recall_curve(spark, folder):
    return scoring.pr_curve(predictions(spark, folder)).drop("auc").withColumns({c: r6(c) for c in ("precision", "recall", "baseline")})


@query(
    "K21",
    sql=f"""WITH {CURVE}, points AS (
      SELECT classifier, score, tp / (tp + fp)::DOUBLE AS p, tp / n_pos::DOUBLE AS r FROM curve
      UNION ALL SELECT DISTINCT classifier, 'infinity'::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM curve),
    next AS (SELECT classifier, p, r, lead(p) OVER w AS p2, lead(r) OVER w AS r2 FROM points WINDOW w AS (PARTITION BY classifier ORDER BY score))
    SELECT classifier, round(sum((r - r2) * (p + p2) / 2), 6) AS auc FROM next WHERE p2 IS NOT NULL GROUP BY classifier""",
)
def precision_recall_area(spark, folder):
    return scoring.pr_curve(predictions(spark, folder)).select("classifier", r6("auc").alias("auc")).distinct()


# ---- fold scores, ranks, result table --------------------------------------------

FOLD_CELLS = f"""{PREDICTIONS}, {RANKED},
fold_cells AS (SELECT p.classifier, CAST((k.r - 1) % 5 AS INTEGER) AS fold, count(*) FILTER (p.y = 0 AND yhat = 0) AS tn,
  count(*) FILTER (p.y = 0 AND yhat = 1) AS fp, count(*) FILTER (p.y = 1 AND yhat = 0) AS fn, count(*) FILTER (p.y = 1 AND yhat = 1) AS tp
  FROM predictions p JOIN ranked k ON k.doc_id = p.doc_id GROUP BY 1, 2),
fold_rates AS (SELECT classifier, fold, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM fold_cells),
fold_long AS (UNPIVOT fold_rates ON precision, recall, f1 INTO NAME metric VALUE value),
over_folds AS (SELECT classifier, metric, avg(value) AS mean, stddev_pop(value) AS std FROM fold_long GROUP BY classifier, metric)"""


def fold_metrics(spark, folder):
    folds = classify.with_folds(marks(spark, folder)).select("doc_id", "fold")
    met = predictions(spark, folder).join(folds, "doc_id")
    rates = scoring.metrics_from_cells(scoring.cells(met, "classifier", "fold"))
    return rates.unpivot(["classifier", "fold"], ["precision", "recall", "f1"], "metric", "value")


@query(
    "A18",
    sql=f"WITH {FOLD_CELLS} SELECT classifier, metric, round(mean, 6) AS mean, round(std, 6) AS std, round(std / 2, 6) AS half_std FROM over_folds",
)
def mean_over_folds(spark, folder):
    m = scoring.over_folds(fold_metrics(spark, folder), ["classifier", "metric"])
    return m.withColumns({c: r6(c) for c in ("mean", "std", "half_std")})


@query(
    "W7",
    sql=f"""WITH {FOLD_CELLS} SELECT classifier, metric, CAST(rank() OVER (PARTITION BY metric ORDER BY round(mean, 6) DESC) AS INTEGER) AS rank
    FROM over_folds""",
)
def grid_point_ranks(spark, folder):
    means = mean_over_folds(spark, folder).select("classifier", "metric", "mean")
    return scoring.rank_grid_points(means).drop("mean")


@query(
    "K23",
    sql=f"""WITH {FOLD_CELLS}, {CELLS.split(PREDICTIONS + ',')[1]},
    whole AS (SELECT classifier, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rates),
    folds AS (SELECT classifier, max(mean) FILTER (metric = 'precision') AS p, max(mean) FILTER (metric = 'recall') AS r,
                     max(mean) FILTER (metric = 'f1') AS f FROM over_folds GROUP BY classifier)
    SELECT w.classifier, round_even(o.p, 3) AS "5_fold_cv_precision", round_even(o.r, 3) AS "5_fold_cv_recall", round_even(o.f, 3) AS "5_fold_cv_f1",
           round_even(w.precision, 3) AS hold_out_precision, round_even(w.recall, 3) AS hold_out_recall, round_even(w.f1, 3) AS hold_out_f1
    FROM whole w JOIN folds o ON o.classifier = w.classifier""",
)
def classifier_result_table(spark, folder):
    cv = scoring.over_folds(fold_metrics(spark, folder), ["classifier", "metric"]).select(
        "classifier", F.lit("5_fold_cv").alias("part"), "metric", F.col("mean").alias("value")
    )
    whole = scoring.metrics_from_cells(scoring.cells(predictions(spark, folder), "classifier"))
    held = whole.unpivot(["classifier"], ["precision", "recall", "f1"], "metric", "value").withColumn("part", F.lit("hold_out"))
    return scoring.result_table(cv.unionByName(held))


QUESTIONS = f"""{THREADS},
questions AS (SELECT post_fullname, text, CAST(length(text) > 1500 AS INTEGER) AS yhat FROM labelled WHERE send_to_mturk = 2),
answers AS (SELECT post_fullname, count(*) FILTER (role = 'user') AS yes_count, count(*) FILTER (role <> 'user') AS no_count,
  sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END)::DOUBLE AS yes_score,
  sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END)::DOUBLE AS no_score
  FROM (SELECT 't3_' || conv_id AS post_fullname, role, text FROM conversations) GROUP BY post_fullname)"""


def test_questions(spark, folder):
    asked = threads(spark, folder).where(F.col("send_to_mturk") == 2)
    return asked.select("post_fullname", "text", (F.length("text") > 1500).cast("int").alias("yhat"))


@query(
    "K24",
    "F15",
    sql=f"""WITH {QUESTIONS} SELECT q.post_fullname, q.yhat AS predicted_right, CAST(a.yes_count > a.no_count AS INTEGER) AS workers_right,
    CAST(a.no_score > a.yes_score AS INTEGER) AS workers_wrong FROM questions q LEFT JOIN answers a ON a.post_fullname = q.post_fullname""",
)
def question_outcomes(spark, folder):
    turns = table(spark, folder, "conversations", "conv_id", "role", "text")
    yes = F.col("role") == "user"
    answers = turns.groupBy(F.concat(F.lit("t3_"), "conv_id").alias("post_fullname")).agg(
        F.count_if(yes).alias("yes_count"),
        F.count_if(~yes).alias("no_count"),
        F.sum(F.when(yes, F.length("text")).otherwise(0)).cast("double").alias("yes_score"),
        F.sum(F.when(~yes, F.length("text")).otherwise(0)).cast("double").alias("no_score"),
    )
    return scoring.test_question_outcomes(test_questions(spark, folder), answers)


@query(
    "J9",
    sql="""SELECT a.doc_id, count(b.doc_id) AS n_matches, coalesce(sum(b.quality), 0)::BIGINT AS n_positive
    FROM documents a LEFT JOIN (SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id) b
    ON b.text = a.text GROUP BY a.doc_id""",
)
def text_keyed_join(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "text")
    held = d.join(table(spark, folder, "labels", "doc_id", "quality"), "doc_id")
    return scoring.match_by_text(d, held, "text", "quality").drop("text")


# ---- learned classifiers ---------------------------------------------------------

def prepared(spark, folder):
    """Labelled documents as word arrays, split into training folds and hold-out."""
    docs = labelled_docs(spark, folder).select("doc_id", "y", T.tokens(F.col("text")).alias("words"))
    split = written(classify.hold_out_split(docs))
    train = split.where(~F.col("hold_out")).drop("hold_out")
    return train, split.where("hold_out").drop("hold_out")


def scored_hold_out(spark, folder, point):
    train, held = prepared(spark, folder)
    fitted, test, model = classify.featurise(train, held, point.max_features, point.longest)
    return classify.fit_point(point, written(fitted, "train"), written(test, "test"))


NAIVE_BAYES = f"""{LABELLED_DOCS}, {RANKED},
split AS (SELECT d.doc_id, d.y, k.r <= round_even(k.n * 0.15::DOUBLE, 0) AS held, {SQL_TOKENS.format('d.text')} AS w
          FROM labelled_docs d JOIN ranked k ON k.doc_id = d.doc_id),
grams AS (SELECT doc_id, y, held, unnest(w) AS g FROM split UNION ALL
          SELECT doc_id, y, held, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM split),
tf AS (SELECT doc_id, y, held, g, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (SELECT g, count(*) AS df, sum(tf) AS total FROM tf WHERE NOT held GROUP BY g HAVING count(*) >= 2
          ORDER BY total DESC, g LIMIT {LIMIT}),
n AS (SELECT count(*) AS n FROM split WHERE NOT held),
weights AS (SELECT tf.doc_id, tf.y, tf.held, tf.g, tf.tf * (ln((1.0 + n.n) / (1.0 + v.df)) + 1.0) AS w FROM tf JOIN vocab v ON v.g = tf.g, n),
x AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM weights),
classes AS (SELECT g, c, df FROM vocab, (SELECT unnest([0, 1]) AS c)),
sums AS (SELECT v.g, v.c, coalesce(sum(x.x) FILTER (x.y <> v.c), 0) AS s FROM classes v
         LEFT JOIN x ON x.g = v.g AND NOT x.held GROUP BY v.g, v.c),
theta AS (SELECT g, c, ln(s + 1.0) - ln(sum(s) OVER (PARTITION BY c) + count(*) OVER (PARTITION BY c)) AS t FROM sums),
scores AS (SELECT s.doc_id, s.y, coalesce(sum(x.x * t.t) FILTER (t.c = 0), 0) AS t0, coalesce(sum(x.x * t.t) FILTER (t.c = 1), 0) AS t1
           FROM split s LEFT JOIN x ON x.doc_id = s.doc_id LEFT JOIN theta t ON t.g = x.g WHERE s.held GROUP BY s.doc_id, s.y)"""


@query(
    "K4",
    "K7",
    "K22",
    sql=f"""WITH {NAIVE_BAYES} SELECT doc_id, 'NB' AS classifier, y, CASE WHEN t1 < t0 THEN 1 ELSE 0 END AS yhat,
    round(1 / (1 + exp(t1 - t0)), 6) AS score FROM scores""",
)
def naive_bayes(spark, folder):
    """Complement naive Bayes on uni- and bigrams, fitted without the hold-out."""
    scored = scored_hold_out(spark, folder, classify.Point("NB", LIMIT, 2))[1]
    return scored.withColumn("score", r6("score"))


@query("K8", "K22")
def logistic_regression(spark, folder):
    return scored_hold_out(spark, folder, classify.Point("LR", None, 1, {"C": 10.0, "penalty": "l2"}))[1]


@query("K9", "K22")
def linear_svm(spark, folder):
    return scored_hold_out(spark, folder, classify.Point("SVM_linear", None, 1, {"C": 1.0}))[1]


@query("K10", "K22")
def rbf_svm(spark, folder):
    return scored_hold_out(spark, folder, classify.Point("SVM_rbf", LIMIT, 1, {"C": 1.0, "gamma": "scale"}))[1]


@query("K11", "K22")
def random_forest(spark, folder):
    return scored_hold_out(spark, folder, classify.Point("RF", LIMIT, 1, {"trees": 100, "criterion": "entropy"}))[1]


@query("W6")
def top_weighted_features(spark, folder):
    train, held = prepared(spark, folder)
    fitted, test, model = classify.featurise(train, held, None, 1)
    svm, _ = classify.fit_point(classify.Point("SVM_linear", None, 1), written(fitted), test)
    rows = classify.top_weighted_features(svm, model.stages[0].vocabulary)
    return spark.createDataFrame(rows, "term STRING, weight DOUBLE")


C_VALUES = (1.0, 10.0, 100.0)


@query("K9", "K22")
def squared_hinge_svm(spark, folder):
    """The linear SVM with squared hinge loss on all terms."""
    train, held = prepared(spark, folder)
    return classify.squared_hinge(train, held, None, 1, 1.0)


def shared_points(max_features, losses=True):
    """Naive Bayes, logistic regression and squared hinge points of the experiments' grid, on single words."""
    points = classify.grid("NB", max_features, (1,))
    points += classify.grid("LR", max_features, (1,), C=C_VALUES, penalty=("l1", "l2"))
    if losses:
        points += classify.grid("SVM_linear", max_features, (1,), C=C_VALUES, loss=("squared_hinge",))
    return points


@query("K5", "K7", "K8", "K9")
def grid_search(spark, folder):
    """Mean, spread and rank of every metric over 5 folds for all feature limits, all terms among them."""
    train, _ = prepared(spark, folder)
    folded = written(classify.with_folds(train))
    return classify.grid_results(classify.grid_search(folded, shared_points(classify.MAX_FEATURES)))


@query("K6")
def nested_grid_search(spark, folder):
    """5 x 5 nested folds over the naive Bayes and logistic regression points of two feature limits."""
    train, _ = prepared(spark, folder)
    return classify.nested_grid_search(train, shared_points((1000, 5000), losses=False))
