"""Boosted trees against the same method over plain arrays, and the stop rule."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lexiforge.operators import boosting as B


def brute_fit(x, y, held, s):
    """Boosting over raw values, every threshold looked at one by one."""
    n, d = x.shape
    classes = int(y.max()) + 1
    share = np.bincount(y[~held], minlength=classes) / (~held).sum()
    scores = np.repeat(np.log(share)[None, :], n, axis=0)
    losses = []
    for _ in range(s.rounds):
        e = np.exp(scores)
        p = e / e.sum(axis=1, keepdims=True)
        step = np.zeros_like(scores)
        for k in range(classes):
            g = (y == k) - p[:, k]

            def grow(rows, depth):
                fit = rows[~held[rows]]
                best = (1e-9, None)
                if depth < s.depth:
                    for f in range(d):
                        for c in sorted({0.0, *x[~held, f]}):
                            l, r = fit[x[fit, f] <= c], fit[x[fit, f] > c]
                            if len(l) and len(r):
                                gain = g[l].sum() ** 2 / len(l) + g[r].sum() ** 2 / len(r) - g[fit].sum() ** 2 / len(fit)
                                if round(gain, 10) > round(best[0], 10):
                                    best = (gain, (f, c))
                if best[1] is None:
                    h = (np.abs(g[fit]) * (1 - np.abs(g[fit]))).sum()
                    step[rows, k] = 0 if h < 1e-12 else s.rate * (classes - 1) / classes * g[fit].sum() / h
                    return
                f, c = best[1]
                grow(rows[x[rows, f] <= c], depth + 1)
                grow(rows[x[rows, f] > c], depth + 1)

            grow(np.arange(n), 0)
        scores += step
        e = np.exp(scores)
        p = e / e.sum(axis=1, keepdims=True)
        losses.append(float(-np.log(p[np.arange(n), y])[held].mean()))
        if B.stops(losses, s.patience, s.tol):
            break
    return scores, losses


def data(seed, n=90, classes=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    y[:classes] = np.arange(classes)
    x = np.round(np.maximum(rng.normal(size=(n, 5)) + 1.2 * (np.arange(5)[None, :] % classes == y[:, None]), 0) * 4) / 4
    held = np.arange(n) % 4 == 3
    return x, y, held


def frame(spark, x, y, held):
    rows = [(i, [float(v) for v in r], float(c), bool(h)) for i, (r, c, h) in enumerate(zip(x, y, held))]
    df = spark.createDataFrame(rows, "id long, v array<double>, label_index double, is_validation boolean")
    return df.withColumn("features", array_to_vector("v"))


@pytest.mark.parametrize("seed, classes, tol", [(1, 3, 0.05), (2, 2, 0.08)])
def test_equals_brute_force_and_stops_with_it(spark, seed, classes, tol):
    x, y, held = data(seed, classes=classes)
    s = B.Settings(rounds=12, tol=tol, patience=3)
    want, losses = brute_fit(x, y, held, s)
    df = frame(spark, x, y, held)
    model = B.fit(df, validation_col="is_validation", s=s)
    assert np.allclose(model.losses, losses) and len(model.rounds) == len(losses)
    assert np.allclose(model.scores(x), want)
    out = model.transform(df).orderBy("id").collect()
    assert [int(r.prediction) for r in out] == want.argmax(axis=1).tolist()
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in out)


def test_stop_rule():
    assert not B.stops([5.0, 4.0, 3.0], 5, 0.01)
    falling = [1 - 0.1 * i for i in range(6)]
    assert not B.stops(falling, 5, 0.01)
    assert not B.stops([1.0, 0.5, 0.5, 0.5, 0.5, 0.5], 5, 0.01)
    assert B.stops([1.0, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5], 5, 0.01)
    assert B.stops([0.5, 0.5, 0.5, 0.5, 0.5, 0.495], 5, 0.01) and not B.stops([0.5, 0.5, 0.5, 0.5, 0.5, 0.48], 5, 0.01)


def test_runs_all_rounds_without_validation(spark):
    x, y, held = data(3)
    model = B.fit(frame(spark, x, y, held).drop("is_validation"), s=B.Settings(rounds=4))
    assert len(model.rounds) == 4 and model.losses == []
    assert (model.scores(x).argmax(axis=1) == y).mean() > 0.6


def test_one_class_and_rows_without_features(spark):
    df = frame(spark, np.zeros((6, 2)), np.zeros(6, int), np.zeros(6, bool))
    model = B.fit(df, s=B.Settings(rounds=2))
    assert {r.prediction for r in model.transform(df).collect()} == {0.0}
    with pytest.raises(ValueError, match="no row"):
        B.fit(df.where("id < 0"))


def test_vectors_hold_their_values(spark):
    from lexiforge.operators import baseline

    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long")
    long = spark.createDataFrame([(1, 0, 0.5), (1, 4, 0.25), (1, 2, -1.0), (2, 4, 1.0), (3, 1, 2.0)], "k long, term_index int, value double")
    got = {r.k: r.features.toArray().tolist() for r in baseline.sparse_features(long, rows, "k", 5).collect()}
    assert got == {1: [0.5, 0, -1.0, 0, 0.25], 2: [0, 0, 0, 0, 1.0], 3: [0, 2.0, 0, 0, 0], 4: [0] * 5}
