"""All columns of a grid in one optimisation, against dense numpy."""

import tracemalloc

import numpy as np
import pytest
from pyspark import RDD
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from forumlens.operators import classify, passes
from forumlens.operators import columns as G
from forumlens.operators.sparse import Sparse
from forumlens.plans import classifiers
from forumlens.session import written

FOLDS, TERMS = 3, 15


@pytest.fixture(scope="module")
def dense():
    draw = np.random.default_rng(5)
    y = (draw.random(90) < 0.35).astype(int)
    x = draw.poisson(0.5 + 1.2 * y[:, None] * (np.arange(TERMS) < 4), (90, TERMS)).astype(float)
    x[3] = 0
    x[:, 14] = 0
    x[5, 14] = 2  # a term of one document
    return x, y, np.arange(90) % FOLDS


@pytest.fixture(scope="module")
def problem(spark, dense):
    x, y, fold = dense
    rows = [
        (i, Vectors.sparse(TERMS, {int(j): v for j, v in enumerate(r) if v}) if i % 2 else Vectors.dense(r), int(y[i]), 7 - (1 << int(fold[i])), 1 << int(fold[i]))
        for i, r in enumerate(x)
    ]
    df = spark.createDataFrame(rows, ["doc_id", "counts", "y", "train", "test"]).repartition(4)
    held, n = G.held_counts(df, "doc_id", "counts")
    assert n == TERMS
    docs, total, size = G.frequencies(held, n, FOLDS)
    names = np.array([f"t{i:02}" for i in range(TERMS)])
    views = [G.view_weights(docs[:, f], total[:, f], size[f], names, m) for m in (None, 6) for f in range(FOLDS)]
    return G.Problem(held, np.stack(views, axis=1), FOLDS), docs, total, size


def features(dense, problem, view):
    scaled = dense[0] * problem.scale[:, view]
    length = np.sqrt((scaled**2).sum(axis=1, keepdims=True))
    return scaled / np.where(length > 0, length, 1)


def test_views_are_those_of_the_training_rows(dense, problem):
    x, y, fold = dense
    own, docs, total, size = problem
    for f in range(FOLDS):
        inside = x[fold != f]
        assert (docs[:, f] == (inside > 0).sum(axis=0)).all() and (total[:, f] == inside.sum(axis=0)).all() and size[f] == len(inside)
        idf = np.where(docs[:, f] >= 2, np.log((1 + len(inside)) / (1 + docs[:, f])) + 1, 0)
        assert np.allclose(own.scale[:, f], idf)
        best = sorted(range(TERMS), key=lambda j: (-(total[j, f] if docs[j, f] >= 2 else -1), j))[:6]
        assert set(np.flatnonzero(own.scale[:, FOLDS + f])) == set(best)


def slopes(dense, problem, column):
    """Gradient of C times the weighted loss at a column's weights, intercept last."""
    x, y, fold = dense
    rows, sign = features(dense, problem, column.view), np.where(y > 0, 1.0, -1.0)
    inside = fold != column.fold
    n = np.array([(inside & (y == c)).sum() for c in (0, 1)])
    weight = inside * (1.0 if column.loss == "squared_hinge" else n.sum() / (2 * n[y]))
    margin = sign * (rows @ column.w[:-1] + column.w[-1])
    slope = -2 * np.maximum(0, 1 - margin) if column.loss == "squared_hinge" else -1 / (1 + np.exp(margin))
    slope = slope * sign * weight * column.c
    return np.append(rows.T @ slope, slope.sum())


def grid():
    return [
        G.Column(FOLDS * m + f, f, loss, c, l1)
        for m in (0, 1)
        for f in range(FOLDS)
        for loss, c, l1 in (("log", 1.0, False), ("log", 10.0, False), ("log", 10.0, True), ("log", 1.0, True), ("squared_hinge", 1.0, False), ("squared_hinge", 10.0, False))
    ]


@pytest.fixture(scope="module")
def fitted(problem):
    found = grid()
    G.minimise(problem[0], found, tolerance=1e-7, steps=600)
    return found


def test_every_column_is_at_its_optimum(dense, problem, fitted):
    for c in fitted:
        g, w = slopes(dense, problem[0], c), c.w
        scale = 1e-4 * max(1.0, c.c)
        if c.l1:
            assert abs(g[-1]) < scale and np.abs(g[:-1][w[:-1] == 0]).max(initial=0) < 1 + scale
            assert np.abs(g[:-1] + np.sign(w[:-1]))[w[:-1] != 0].max(initial=0) < scale
        else:
            under = np.append(w[:-1], w[-1] if c.loss == "squared_hinge" else 0.0)
            assert np.abs(g + under).max() < scale
    assert any((c.w[:-1] == 0).sum() > (problem[0].scale[:, c.view] == 0).sum() for c in fitted if c.l1)


def test_columns_equal_single_fits(problem):
    """A column's steps do not depend on the others: after any number of passes it is where it would be alone."""
    together = grid()
    G.minimise(problem[0], together, tolerance=1e-12, steps=30)
    for i in (1, 2, 22):
        (alone,) = [grid()[i]]
        G.minimise(problem[0], [alone], tolerance=1e-12, steps=30)
        assert alone.steps == together[i].steps > 5
        assert np.abs(alone.w - together[i].w).max() < 1e-6 * max(1.0, np.abs(alone.w).max())


def test_bayes_and_cells(dense, problem, fitted):
    x, y, fold = dense
    own = problem[0]
    bayes = G.complement_bayes(own, [0, 1, 2, 4], [0, 1, 2, 1])
    for c in bayes:
        rows, inside, kept = features(dense, own, c.view), fold != c.fold, own.scale[:, c.view] > 0
        theta = []
        for k in (0, 1):
            sums = rows[inside & (y != k)].sum(axis=0)[kept] + 1.0
            theta.append(np.log(sums / sums.sum()))
        assert np.allclose(c.w[:-1][kept], theta[0] - theta[1]) and not c.w[:-1][~kept].any()
    for c, got in zip([*bayes, *fitted], G.cells(own, [*bayes, *fitted])):
        yes = features(dense, own, c.view) @ c.w[:-1] + c.w[-1] > 0
        test = fold == c.fold
        assert got.tolist() == [(test & (y == a) & (yes == b)).sum() for a in (0, 1) for b in (False, True)]


def test_chunks_hold_all_columns(monkeypatch):
    monkeypatch.setattr(G, "STATE_BYTES", 8 * 101 * (2 * G.MEMORY + 6) * 4)
    assert [len(x) for x in G.chunks(grid(), 100)] == [4] * 9
    monkeypatch.setattr(G, "STATE_BYTES", 1)
    assert [len(x) for x in G.chunks(grid(), 100)] == [1] * 36


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, counts array<double>, y int, train long, test long")
    from pyspark.ml.functions import array_to_vector

    held, n = G.held_counts(df.withColumn("counts", array_to_vector(F.col("counts"))), "doc_id", "counts")
    assert n == 0 and held.count() == 0


@pytest.fixture(scope="module")
def train(spark):
    return written(classifiers.prepared(spark, "/root/testdata/sf0.001")[0])


def test_grid_of_shared_passes_is_that_of_single_fits(train):
    """Naive Bayes and logistic regression, each fold with its own features, as fitted one by one by Spark."""
    points = classify.grid("NB", (40, None), (1, 2)) + classify.grid("LR", (40,), (1,), C=(1.0,), penalty=("l2",))
    folded = written(classify.with_folds(train, folds=3))
    keys = ["classifier", "point", "fold", "tn", "fp", "fn", "tp"]
    got = {tuple(r) for r in classify.grid_search(folded, points).select(*keys).collect()}
    assert got == {tuple(r) for r in classify.cross_validate(folded, points).select(*keys).collect()} and len(got) == 15


def test_nested_folds_choose_on_inner_rows_only(train):
    points = classify.grid("NB", (30, 60), (1,))
    got = classify.nested_grid_search(train, points, folds=3).collect()
    assert sorted(r.fold for r in got) == [0, 1, 2] and {r.point for r in got} <= {p.name for p in points}
    assert sum(r.tn + r.fp + r.fn + r.tp for r in got) == train.count()
    single = classify.nested_cross_validate(train, points, folds=3).collect()
    assert {(r.fold, r.point, r.tp, r.fp) for r in got} == {(r.fold, r.point, r.tp, r.fp) for r in single}


def test_the_driver_takes_whole_sums_in_slabs(spark, monkeypatch):
    """Sums too large to be collected: no tree ends on the driver, and it takes each cell once, some rows at a time."""
    monkeypatch.setattr(passes, "DRIVER_BYTES", 0)
    monkeypatch.setattr(passes, "SLAB_BYTES", 7 * 3 * 8, raising=False)
    taken, take = [], RDD.toLocalIterator

    def noted(self, *rest):
        for item in take(self, *rest):
            taken.append(item[1].nbytes)
            yield item

    monkeypatch.setattr(RDD, "toLocalIterator", noted)
    rows = spark.sparkContext.parallelize(range(60), 9)
    found = passes.summed(rows, lambda part: sum(np.arange(150.0).reshape(50, 3) + i for i in part), (50, 3))
    assert np.array_equal(found, 60 * np.arange(150.0).reshape(50, 3) + 1770)
    assert sum(taken) == 50 * 3 * 8 and max(taken) <= 7 * 3 * 8


def test_blocks_of_rare_terms_stay_sparse(spark):
    """1,600 rows of 40 terms of their own: a dense block over all of their terms would have 800 MB (F1, F6, F9)."""
    vectors = [Vectors.sparse(64_000, range(40 * i, 40 * i + 40), [1.0 + j % 3 for j in range(40)]) for i in range(1600)]
    rows = [(i, v, i % 2, 1 | (i % 2) << 8, 2) for i, v in enumerate(vectors)]
    held, width = G.held_counts(spark.createDataFrame(rows, ["doc_id", "counts", "y", "train", "test"]).coalesce(1), "doc_id", "counts")
    parts = held.collect()
    w = np.random.default_rng(2).random((width, 9))
    wanted = np.array([v.values @ w[v.indices] for v in vectors])
    back = {k: np.zeros((width, k)) for k in (1, 9)}
    tracemalloc.start()
    blocks = [G.Counts(p) for p in parts]
    for k, sums in back.items():
        found = np.concatenate([b.counts.times(w[:, :k]) for b in blocks])
        for b in blocks:
            b.counts.add_transposed(b.counts.times(w[:, :k]), sums)
        assert np.allclose(found, wanted[:, :k])
        assert np.allclose(sums.ravel(), np.concatenate([np.outer(v.values, x[:k]).ravel() for v, x in zip(vectors, wanted)]))
    assert sum(len(b.key) for b in blocks) == 1600 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_passes_have_no_more_tasks_than_cores(spark):
    rows = [(i, Vectors.sparse(5, [i % 5], [1.0]), i % 2, 1, 2) for i in range(100)]
    held, _ = G.held_counts(spark.createDataFrame(rows, ["doc_id", "counts", "y", "train", "test"]).repartition(30), "doc_id", "counts")
    assert held.getNumPartitions() <= spark.sparkContext.defaultParallelism and held.map(lambda p: len(G.Counts(p).key)).sum() == 100


@pytest.mark.parametrize("width", [1, 3, 9])
def test_sparse_products_equal_dense_ones(width):
    """Frequent and rare columns, empty rows, numbers of both signs, no rows at all."""
    draw = np.random.default_rng(width)
    x = draw.normal(size=(70, 50)) * (draw.random((70, 50)) < np.where(np.arange(50) < 6, 0.6, 0.02))
    x[[0, 5, 69]] = 0
    for cells in (x, x[:0]):
        row, col = np.nonzero(cells)
        own, at = np.unique(col, return_inverse=True)
        block = Sparse(np.bincount(row, minlength=len(cells)), own, at, cells[row, col])
        z, y, out = draw.random((50, width)), draw.random((len(cells), width)), np.ones((50, width))
        assert np.allclose(block.times(z), cells @ z)
        block.add_transposed(y, out)
        assert np.allclose(out, 1 + cells.T @ y)
