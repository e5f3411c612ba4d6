"""Splits, classifiers, grid search and hold-out evaluation.

Training rows have the shape (doc_id, y, words) with `words` an array of
tokens; `fold` and `weight` are added here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product as combinations
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.functions.keys import draw_key
from forumlens.functions.text import ngrams
from forumlens.operators import columns, filters, scoring
from forumlens.operators.ranking import rank_by_draw
from forumlens.operators.vocabulary import fit_vectoriser, vectorise
from forumlens.session import written

# Fixed values of the experiments.
SEED = 123
HOLD_OUT = 0.15
FOLDS = 5
MAX_FEATURES = (1000, 5000, 10000, None)
NGRAMS = (1, 2, 3)
NAMES = {
    "LR": "Logistic Regression",
    "NB": "Naive Bayes",
    "RF": "Random Forest",
    "SVM_linear": "Linear SVM",
    "SVM_rbf": "Radial Bias Function SVM",
}
TREE_DEPTH = 30  # the deepest Spark grows
TREE_ROWS = 250_000  # rows at most that a task of a forest's passes holds, where there are partitions enough
TREE_MB = 512  # of the counts of nodes that a task adds up in a pass; nodes beyond them take a further pass


def hold_out_split(df: DataFrame, key: str = "doc_id", label: str = "y", share: float = HOLD_OUT, seed: int = SEED):
    """Adds `hold_out`: `share` of every class, drawn by key.

    Only keys and labels are ranked. What comes back to the rows is the last
    draw of each class that is held out, one broadcast row per class, so texts
    are marked where they are read.
    """
    ranked = rank_by_draw(df.select(key, label), [label], key, seed)
    totals = df.groupBy(label).agg(F.bround(F.count("*") * F.lit(share), 0).alias("__n"))
    draw = F.struct(draw_key(seed, F.col(key)).alias("d"), F.col(key).alias("k"))
    last = ranked.join(totals, label).groupBy(label).agg(F.max(F.when(F.col("rank") <= F.col("__n"), draw)).alias("__last"))
    marked = df.join(F.broadcast(last), label)
    return marked.withColumn("hold_out", F.coalesce(draw <= F.col("__last"), F.lit(False))).drop("__last").select(*df.columns, "hold_out")


def with_folds(df: DataFrame, key: str = "doc_id", label: str = "y", folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Adds `fold` 0..folds-1, every class dealt out evenly."""
    ranked = rank_by_draw(df.select(key, label), [label], key, seed)
    return df.join(ranked.select(key, ((F.col("rank") - 1) % folds).cast("int").alias("fold")), key)


def balanced_weights(df: DataFrame, label: str = "y", weight: str = "weight") -> DataFrame:
    """Adds N / (2 * n_y). The class counts are two numbers, read as subqueries."""
    n = df.select(F.count("*")).scalar()
    pos = df.select(F.count_if(F.col(label) == 1)).scalar()
    return df.withColumn(weight, n / (F.lit(2.0) * F.when(F.col(label) == 1, pos).otherwise(n - pos)))


def majority_baseline(df: DataFrame, label: str = "y") -> DataFrame:
    """Class priors and the class a constant classifier predicts."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    n = df.select(F.count("*")).scalar()
    top = counts.orderBy(F.desc("n"), label).limit(1).select(label).scalar()
    return counts.select(label, "n", (F.col("n") / n).alias("prior"), (F.col(label) == top).cast("int").alias("predicted"))


@dataclass(frozen=True)
class Point:
    """One grid point: a classifier with its settings and its features."""

    classifier: str
    max_features: int | None = None
    longest: int = 1
    settings: dict = field(default_factory=dict, hash=False)

    @property
    def name(self) -> str:
        extra = [f"{k}={self.settings[k]}" for k in sorted(self.settings)]
        return ",".join([self.classifier, f"max_features={self.max_features}", f"ngrams=1-{self.longest}", *extra])


def grid(classifier: str, max_features=MAX_FEATURES, longest=NGRAMS, **ranges: Sequence) -> list[Point]:
    """All combinations of feature limits and settings for one classifier."""
    names = sorted(ranges)
    return [
        Point(classifier, m, n, dict(zip(names, values)))
        for m, n in combinations(max_features, longest)
        for values in combinations(*[ranges[k] for k in names])
    ]


def full_grid(classifier: str | None = None) -> list[Point]:
    """The experiments' grid, but for the choice of solver: an optimum does not depend on it."""
    c = (1.0, 10.0, 100.0)
    grids = {
        "NB": grid("NB"),
        "LR": grid("LR", C=c, penalty=("l1", "l2")),
        "SVM_linear": grid("SVM_linear", C=c, loss=("hinge", "squared_hinge")),
        "SVM_rbf": grid("SVM_rbf", C=c, gamma=("scale", "auto")),
        "RF": grid("RF", trees=tuple(range(1500, 2010, 100)), criterion=("entropy", "gini")),
    }
    return [p for name, points in grids.items() if classifier in (None, name) for p in points]


def estimator(point: Point, total_weight: float, features: str = "features"):
    """The Spark estimator of a grid point. C weighs the loss against the
    penalty; Spark averages the loss, hence 1 / (C * total weight)."""
    s = point.settings
    common = {"featuresCol": features, "labelCol": "y", "predictionCol": "yhat"}
    if point.classifier == "NB":
        return NaiveBayes(modelType="complement", **common)
    if point.classifier == "LR":
        return LogisticRegression(
            regParam=1.0 / (s.get("C", 1.0) * total_weight),
            elasticNetParam=1.0 if s.get("penalty", "l2") == "l1" else 0.0,
            standardization=False,
            weightCol="weight",
            maxIter=s.get("iterations", 200),
            **common,
        )
    if point.classifier in ("SVM_linear", "SVM_rbf"):
        return LinearSVC(
            regParam=1.0 / (s.get("C", 1.0) * total_weight),
            standardization=False,
            maxIter=s.get("iterations", 200),
            **common,
        )
    if point.classifier == "RF":
        return RandomForestClassifier(
            numTrees=s.get("trees", 1500),
            maxDepth=s.get("depth", TREE_DEPTH),
            impurity=s.get("criterion", "gini"),
            weightCol="weight",
            seed=SEED,
            cacheNodeIds=True,
            maxMemoryInMB=TREE_MB,
            **common,
        )
    raise ValueError(f"unknown classifier {point.classifier}")


def score_column(df: DataFrame) -> Column:
    """Decision value when the model has one, else P(class 1)."""
    name = "rawPrediction" if "probability" not in df.columns else "probability"
    return F.get(vector_to_array(name), F.lit(1))


def projected_rows(matrix: IndexedRowMatrix, factors: DenseMatrix, key: str, output: str) -> DataFrame:
    """(key, array) of the rows of `matrix` times a local matrix, all of it in the JVM."""
    product = matrix.multiply(factors)
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    rows = MLUtils.convertVectorColumnsToML(rows, "vector")
    return rows.select(F.col("index").alias(key), vector_to_array("vector").alias(output))


def random_fourier(df: DataFrame, key: str, vector: str, gamma: float, dimensions: int = 256, seed: int = SEED):
    """Features whose inner products approximate the RBF kernel: cos(Wx + b).

    W has columns x dimensions numbers, both fixed by settings.
    """
    columns = len(df.select(vector).first()[0])
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2.0 * gamma), size=(columns, dimensions))
    shift = rng.uniform(0.0, 2.0 * np.pi, size=dimensions)
    rows = df.select(F.col(key).cast("bigint").alias("index"), F.col(vector).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "vector"))
    wx = projected_rows(matrix, DenseMatrix(columns, dimensions, w.ravel(order="F")), key, "__wx")
    shifts = F.array(*[F.lit(float(b)) for b in shift])
    scale = F.lit(float(np.sqrt(2.0 / dimensions)))
    mapped = F.zip_with("__wx", shifts, lambda x, b: scale * F.cos(x + b))
    return df.drop(vector).join(wx.select(key, array_to_vector(mapped).alias(vector)), key)


def kernel_width(df: DataFrame, vector: str, gamma: str | float) -> float:
    """`auto` is 1 / columns, `scale` is 1 / (columns * variance of all entries)."""
    if not isinstance(gamma, str):
        return float(gamma)
    columns = len(df.select(vector).first()[0])
    if gamma == "auto":
        return 1.0 / columns
    sums = df.select(Summarizer.metrics("mean", "normL2", "count").summary(F.col(vector)).alias("s")).select("s.*").first()
    squares = float((sums["normL2"].toArray() ** 2).sum()) / sums["count"]
    variance = squares / columns - (float(sums["mean"].toArray().sum()) / columns) ** 2
    return 1.0 / (columns * variance) if variance > 0 else 1.0


def featurise(train: DataFrame, test: DataFrame, max_features: int | None, longest: int, key: str = "doc_id"):
    """TF-IDF vectors of both parts, the vocabulary fitted on `train` only."""

    def with_terms(df: DataFrame) -> DataFrame:
        return df.withColumn("terms", ngrams(F.col("words"), longest))

    model = fit_vectoriser(with_terms(train), "terms", min_df=2, max_features=max_features)
    keep = [key, "y", "features"]
    return (
        balanced_weights(vectorise(model, with_terms(train)).select(*keep)),
        vectorise(model, with_terms(test)).select(*keep),
        model,
    )


def in_whole_waves(rows: DataFrame, n: int) -> DataFrame:
    """The n rows in as many partitions as there are cores, or a multiple of it that keeps to `TREE_ROWS`.

    Every task of a forest's pass sends the counts of all nodes of the pass,
    so partitions beyond the cores only add to what is sent.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(cores * max(1, math.ceil(n / (cores * TREE_ROWS))))


def fit_point(point: Point, train: DataFrame, test: DataFrame, key: str = "doc_id"):
    """Fit one grid point on featurised rows; returns (model, scored test rows)."""
    if point.classifier == "SVM_rbf":
        gamma = kernel_width(train, "features", point.settings.get("gamma", "scale"))
        train = balanced_weights(random_fourier(train.drop("weight"), key, "features", gamma))
        test = random_fourier(test, key, "features", gamma)
    total = train.agg(F.sum("weight")).first()[0] if point.classifier == "LR" else train.count()
    if point.classifier == "RF":
        train = in_whole_waves(train, total)
    model = estimator(point, float(total)).fit(train)
    scored = model.transform(test)
    return model, scored.select(
        key,
        F.lit(point.classifier).alias("classifier"),
        F.col("y").cast("int").alias("y"),
        F.col("yhat").cast("int").alias("yhat"),
        score_column(scored).alias("score"),
    )


def cross_validate(train: DataFrame, points: Sequence[Point], key: str = "doc_id", parallelism: int = 4) -> DataFrame:
    """(classifier, point, fold, tn, fp, fn, tp) and all metrics for every grid point and fold.

    Features are fitted once per (fold, feature limits) and written, so the
    classifiers of that feature set read them instead of redoing the text work.
    `parallelism` of these run at a time, as in Spark's own CrossValidator.
    """
    folds = [r[0] for r in train.select("fold").distinct().orderBy("fold").collect()]
    feature_sets = sorted({(p.max_features or 0, p.longest) for p in points})

    def evaluate(task) -> list[tuple]:
        fold, (limit, longest) = task
        inside, outside = train.where(F.col("fold") != fold), train.where(F.col("fold") == fold)
        fitted, held, _ = featurise(inside, outside, limit or None, longest, key)
        fitted, held = written(fitted, "train"), written(held, "test")
        rows = []
        for p in points:
            if (p.max_features or 0, p.longest) == (limit, longest):
                _, scored = fit_point(p, fitted, held, key)
                cell = scoring.cells(scored).first()
                rows.append((p.classifier, p.name, fold, cell["tn"], cell["fp"], cell["fn"], cell["tp"]))
        return rows

    inherit = inheritable_thread_target(train.sparkSession)
    with ThreadPool(parallelism) as pool:
        rows = [r for part in pool.map(inherit(evaluate), combinations(folds, feature_sets)) for r in part]
    schema = "classifier STRING, point STRING, fold INT, tn BIGINT, fp BIGINT, fn BIGINT, tp BIGINT"
    return scoring.metrics_from_cells(train.sparkSession.createDataFrame(rows, schema))


def in_columns(point: Point) -> bool:
    """Points that `grid_cells` fits: naive Bayes, logistic regression and the SVM with squared hinge."""
    return point.classifier in ("NB", "LR") or (point.classifier == "SVM_linear" and point.settings.get("loss") == "squared_hinge")


def counted_terms(rows: DataFrame, longest: int):
    """Rows with count vectors over all terms of two documents or more, and these terms."""
    terms = rows.withColumn("terms", ngrams(F.col("words"), longest)).drop("words")
    counter = fit_vectoriser(terms, "terms", min_df=2).stages[0]
    return counter.transform(terms).drop("terms"), np.array(counter.vocabulary, dtype=object)


def column_of(point: Point, view: int, fold: int) -> columns.Column:
    loss = "log" if point.classifier == "LR" else "squared_hinge"
    settings = point.settings
    return columns.Column(view, fold, loss, settings.get("C", 1.0), settings.get("penalty") == "l1")


def grid_cells(rows: DataFrame, folds: int, points: Sequence[Point], key: str = "doc_id") -> list[tuple]:
    """(point, fold, tn, fp, fn, tp) of every point on every fold, fitted side by side (`operators.columns`).

    `rows` have a key, `y`, `words`, and bit masks `train` and `test` of the
    folds that a row trains and tests; folds may overlap in any way. Each fold
    has its own vocabulary and TF-IDF. Terms are counted once for each length
    of n-grams; all points and folds of a feature limit share every pass, as
    many at a time as the driver's bound on weights allows.
    """
    found = []
    for longest in sorted({p.longest for p in points}):
        counted, names = counted_terms(rows, longest)
        held, width = columns.held_counts(counted, key, "counts")
        docs, total, size = columns.frequencies(held, width, folds)
        for limit in sorted({p.max_features for p in points if p.longest == longest}, key=lambda m: m or np.inf):
            own = [p for p in points if p.longest == longest and p.max_features == limit]
            views = [columns.view_weights(docs[:, f], total[:, f], size[f], names, limit) for f in range(folds)]
            scale = np.stack(views, axis=1)
            kept = np.flatnonzero(scale.any(axis=1))
            some = columns.restricted(held, kept, width)
            problem = columns.Problem(some, scale[kept], folds)
            fits = [(p, column_of(p, f, f)) for p in own if p.classifier != "NB" for f in range(folds)]
            for part in columns.chunks([c for _, c in fits], len(kept)):
                columns.minimise(problem, part)
            bayes = [p for p in own if p.classifier == "NB"]
            for p in bayes:
                fits += [(p, c) for c in columns.complement_bayes(problem, range(folds), range(folds))]
            found += [(p, c.fold, *n) for (p, c), n in zip(fits, columns.cells(problem, [c for _, c in fits]).tolist())]
            problem.close()
            some.unpersist()
        held.unpersist()
    return found


def grid_search(train: DataFrame, points: Sequence[Point], key: str = "doc_id") -> DataFrame:
    """`cross_validate` of points that share passes: metrics of every point and fold of the column `fold`."""
    folds = train.agg(F.max("fold")).first()[0] + 1
    test = F.expr("shiftleft(1L, fold)")
    rows = train.select(key, "y", "words", (F.lit((1 << folds) - 1) - test).alias("train"), test.alias("test"))
    found = [(p.classifier, p.name, f, *n) for p, f, *n in grid_cells(rows, folds, points, key)]
    schema = "classifier STRING, point STRING, fold INT, tn BIGINT, fp BIGINT, fn BIGINT, tp BIGINT"
    return scoring.metrics_from_cells(train.sparkSession.createDataFrame(found, schema))


def nested_grid_search(train: DataFrame, points: Sequence[Point], key: str = "doc_id", folds: int = FOLDS, refit: str = "precision"):
    """Metrics of every outer fold, tuned by a grid search on the other folds, for each classifier.

    All inner and outer fits share their passes: an outer fold has `folds`
    inner ones and a last one that trains on all of them and tests the outer.
    """
    keys = written(with_folds(train.select(key, "y"), key, folds=folds, seed=SEED).withColumnRenamed("fold", "outer_fold"))
    marked = keys
    for o in range(folds):
        inner = with_folds(keys.where(F.col("outer_fold") != o), key, folds=folds, seed=SEED + 1)
        marked = marked.join(inner.select(key, F.col("fold").alias(f"inner_{o}")), key, "left")
    bits = {"train": [], "test": []}
    for o in range(folds):
        inside = F.col("outer_fold") != o
        for i in range(folds):
            tests = F.col(f"inner_{o}") == i
            bits["train"].append(inside & ~tests)
            bits["test"].append(inside & tests)
        bits["train"].append(inside)
        bits["test"].append(~inside)

    def mask(conditions):
        parts = [F.when(c, F.lit(1 << b)).otherwise(F.lit(0)).cast("bigint") for b, c in enumerate(conditions)]
        return reduce(lambda a, b: a + b, parts)

    rows = marked.select(key, mask(bits["train"]).alias("train"), mask(bits["test"]).alias("test"))
    rows = written(train.select(key, "y", "words").join(rows, key), "masked")
    found = [
        (p.classifier, p.name, f // (folds + 1), f % (folds + 1), *n)
        for p, f, *n in grid_cells(rows, folds * (folds + 1), points, key)
    ]
    schema = "classifier STRING, point STRING, fold INT, inner INT, tn BIGINT, fp BIGINT, fn BIGINT, tp BIGINT"
    table = written(train.sparkSession.createDataFrame(found, schema), "cells")
    scored = scoring.metrics_from_cells(table)
    means = scored.where(F.col("inner") < folds).groupBy("classifier", "fold", "point").agg(F.avg(refit).alias("mean"))
    order = Window.partitionBy("classifier", "fold").orderBy(F.desc("mean"), "point")
    best = means.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("classifier", "fold", "point")
    return scored.where(F.col("inner") == folds).drop("inner").join(best, ["classifier", "fold", "point"])


def squared_hinge(train: DataFrame, held: DataFrame, max_features: int | None, longest: int, c: float, key: str = "doc_id") -> DataFrame:
    """The hold-out rows scored by a linear SVM with squared hinge loss, its features fitted on `train` only."""
    both = train.withColumn("train", F.lit(1)).withColumn("test", F.lit(0))
    both = both.unionByName(held.withColumn("train", F.lit(0)).withColumn("test", F.lit(1)))
    counted, names = counted_terms(both.select(key, "y", "words", "train", "test"), longest)
    rows, width = columns.held_counts(counted, key, "counts")
    docs, total, size = columns.frequencies(rows, width, 1)
    problem = columns.Problem(rows, columns.view_weights(docs[:, 0], total[:, 0], size[0], names, max_features)[:, None], 1)
    fitted = columns.Column(0, 0, "squared_hinge", c)
    columns.minimise(problem, [fitted])
    found = columns.scores(problem, fitted)
    return found.select(
        F.col("key").alias(key),
        F.lit("SVM_linear").alias("classifier"),
        "y",
        (F.col("score") > 0).cast("int").alias("yhat"),
        "score",
    )


def grid_results(fold_metrics: DataFrame) -> DataFrame:
    """Mean, spread and rank of every metric over the folds, per grid point."""
    long = fold_metrics.unpivot(["classifier", "point", "fold"], scoring.METRICS, "metric", "value")
    return scoring.rank_grid_points(scoring.over_folds(long, ["classifier", "point", "metric"]))


def best_point(fold_metrics: DataFrame, points: Sequence[Point], refit: str = "precision") -> Point:
    """The grid point of best mean `refit`, ties by name."""
    means = fold_metrics.groupBy("point").agg(F.avg(refit).alias("mean"))
    name = means.orderBy(F.desc("mean"), "point").first()["point"]
    return next(p for p in points if p.name == name)


def nested_cross_validate(train: DataFrame, points: Sequence[Point], key: str = "doc_id", folds: int = FOLDS):
    """Metrics of every outer fold, each tuned by a grid search on the other folds."""
    outer = with_folds(train, key, folds=folds, seed=SEED).withColumnRenamed("fold", "outer_fold")
    outer = written(outer)
    result = None
    for fold in range(folds):
        inside, outside = outer.where(F.col("outer_fold") != fold), outer.where(F.col("outer_fold") == fold)
        inner = written(with_folds(inside.drop("outer_fold"), key, folds=folds, seed=SEED + 1))
        chosen = best_point(cross_validate(inner, points, key), points)
        fitted, held, _ = featurise(inner, outside, chosen.max_features, chosen.longest, key)
        _, scored = fit_point(chosen, fitted, held, key)
        part = scoring.cells(scored).select(
            F.lit(chosen.classifier).alias("classifier"), F.lit(chosen.name).alias("point"), F.lit(fold).alias("fold"), "*"
        )
        result = part if result is None else result.unionByName(part)
    return scoring.metrics_from_cells(result)


def top_weighted_features(model, words: Sequence[str], n: int = 20):
    """The n largest coefficients of a linear model with their terms.

    Coefficients and vocabulary are both driver-side and of the same bounded size.
    """
    weights = model.coefficients.toArray()
    order = sorted(range(len(words)), key=lambda i: (-weights[i], words[i]))[:n]
    return [(words[i], float(weights[i])) for i in order]


def hold_out_with_questions(threads: DataFrame, key: str = "post_fullname", label: str = "health_claim") -> DataFrame:
    """The hold-out threads plus all test questions, which are in no other part."""
    labelled = filters.override_label(threads, label)
    split = hold_out_split(filters.without_test_questions(labelled), key, label).where("hold_out")
    held = split.select(key, label, F.lit(False).alias("is_test_question"))
    questions = labelled.where(F.col("send_to_mturk") == 2).select(key, label, F.lit(True).alias("is_test_question"))
    return held.unionByName(questions)
