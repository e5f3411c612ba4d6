"""Metrics and curves, with tied scores and classes never predicted."""

import pytest
from pyspark.sql import functions as F

from frames import rows
from forumlens.operators import classify, scoring

SCHEMA = "classifier STRING, y INT, yhat INT, score DOUBLE"


def frame(spark, pairs, name="c"):
    return spark.createDataFrame([(name, y, yhat, float(s)) for y, yhat, s in pairs], SCHEMA)


def test_nothing_predicted_positive(spark):
    df = frame(spark, [(0, 0, 0.1), (1, 0, 0.2), (0, 0, 0.3)])
    m = scoring.metrics_from_cells(scoring.cells(df, "classifier")).first()
    assert (m.precision, m.recall, m.f1, m.tp, m.tn) == (0.0, 0.0, 0.0, 0, 2)
    grid = {(r.y, r.yhat): (r.n, r.normalised) for r in scoring.confusion_matrix(df, "classifier").collect()}
    assert grid == {(0, 0): (2, 1.0), (0, 1): (0, 0.0), (1, 0): (1, 1.0), (1, 1): (0, 0.0)}


def test_everything_predicted_positive(spark):
    m = scoring.metrics_from_cells(scoring.cells(frame(spark, [(0, 1, 1), (1, 1, 1), (1, 1, 1)]), "classifier")).first()
    assert m.recall == 1.0 and abs(m.precision - 2 / 3) < 1e-12 and m.average_recall == 0.5


def test_report_means(spark):
    report = {r.label: r for r in scoring.classification_report(frame(spark, [(0, 0, 1), (0, 1, 1), (1, 1, 1), (1, 1, 1)]), "classifier").collect()}
    assert report["0"].recall == 0.5 and report["1"].support == 2
    assert abs(report["macro avg"].recall - 0.75) < 1e-12 and report["weighted avg"].support == 4


TIED = [(i % 3 == 0, i % 2, (i * 7) % 10) for i in range(60)]


def test_roc_curve_with_ties(spark):
    pairs = [(int(y), yhat, s) for y, yhat, s in TIED]
    df = frame(spark, pairs)
    curve = rows(scoring.roc_curve(df).select("fpr", "tpr", "auc_score", "auc_hard"), "fpr", "tpr")
    pos, neg = [s for y, _, s in pairs if y], [s for y, _, s in pairs if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(curve[0][2] - auc) < 1e-12
    assert curve[0][:2] == (0.0, 0.0) and curve[-1][:2] == (1.0, 1.0) and len(curve) == 11
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(curve, curve[1:]))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    assert abs(area - auc) < 1e-12


def test_precision_recall_area(spark):
    pairs = [(int(y), yhat, s) for y, yhat, s in TIED]
    points = scoring.pr_curve(frame(spark, pairs))
    got = points.orderBy(F.col("score").asc_nulls_last()).collect()
    area = sum((a.recall - b.recall) * (a.precision + b.precision) / 2 for a, b in zip(got, got[1:]))
    assert abs(area - got[0].auc) < 1e-12
    assert (got[-1].recall, got[-1].precision) == (0.0, 1.0) and got[0].baseline == 20 / 60


def test_average_precision_closed_form(spark):
    pairs = [(1, 1, 1), (1, 0, 0), (0, 1, 1), (0, 0, 0), (0, 0, 0)]
    m = scoring.metrics_from_cells(scoring.cells(frame(spark, pairs), "classifier")).first()
    # thresholds 1 and 0: precision 1/2 at recall 1/2, then 2/5 at recall 1
    assert abs(m.weighted_average_precision - (0.5 * 0.5 + 0.5 * 0.4)) < 1e-12


def test_text_join_counts_copies(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "i INT, text STRING")
    held = spark.createDataFrame([("a", 1)] * 500 + [("a", 0)] * 20, "text STRING, yhat INT")
    assert rows(scoring.match_by_text(asked, held).select("i", "n_matches", "n_positive"), "i") == [(1, 520, 500), (2, 0, 0)]


def test_result_table(spark):
    long = [(c, p, m, v) for c in ("b", "a") for p in ("5_fold_cv", "hold_out") for m, v in (("precision", 0.12345), ("recall", 0.5), ("f1", 1.0))]
    table = scoring.result_table(spark.createDataFrame(long, "classifier STRING, part STRING, metric STRING, value DOUBLE"))
    assert [r.classifier for r in table.collect()] == ["a", "b"] and table.first()["5_fold_cv_precision"] == 0.123


def test_splits_are_stratified(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    held = classify.hold_out_split(df).where("hold_out").groupBy("y").count()
    assert rows(held, "y") == [(0, 135), (1, 15)]
    folds = {(r.y, r.fold): r["count"] for r in classify.with_folds(df).groupBy("y", "fold").count().collect()}
    assert all(folds[(0, f)] == 180 and folds[(1, f)] == 20 for f in range(5))
    weights = classify.balanced_weights(df).groupBy("y").agg(F.sum("weight").alias("w"))
    assert [round(r.w, 6) for r in weights.collect()] == [500.0, 500.0]


def test_unknown_classifier(spark):
    with pytest.raises(ValueError):
        classify.estimator(classify.Point("x"), 1.0)


def test_grid_sizes():
    assert len(classify.full_grid("NB")) == 12
    assert len(classify.full_grid("LR")) == 72
    assert {p.classifier for p in classify.full_grid()} == set(classify.NAMES)
