import math
from fractions import Fraction

import numpy as np
import pytest

from lexiforge.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n string, whitened string"


def brute(rows):
    """(n, S, covariance as exact fractions, x per row) from the definition, by products."""
    fine = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in fine})
    n, d = len(distinct), len(distinct[0])
    total = [sum(x[k] for x in distinct) for k in range(d)]
    y = [[n * x[k] - total[k] for k in range(d)] for x in distinct]
    cov = [[Fraction(sum(r[a] * r[b] for r in y), n**3) for b in range(d)] for a in range(d)]
    return n, total, cov, fine


def result(spark, rows):
    df = spark.createDataFrame([(i, v, 0, "own", "own", "own") for i, v in rows], SCHEMA)
    return wh.by_component(wh.whiten(df)).collect()


@pytest.mark.parametrize("d, spread", [(20, 1.0), (5, 1.0), (18, 1e4)])
def test_equals_brute_force(spark, d, spread):
    rng = np.random.default_rng(d)
    v = rng.normal(size=(150, d)) @ rng.normal(size=(d, d)) * np.geomspace(spread, 1, d)
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(7, v[7].tolist())] * 40 + [(900, v[8].tolist()), (None, v[9].tolist())]
    n, total, cov, fine = brute(rows)
    out = result(spark, rows)
    k = min(d, 16)
    assert len(out) == len(rows) * k and {r.n for r in out} == {n}
    values, vectors = np.linalg.eigh(np.array(cov, float))
    values, vectors = values[::-1], vectors[:, ::-1]
    got = {}
    for r in out:
        got.setdefault((r.vec_id, r.component), set()).add((r.deviation, r.whitened, r.explained))
    assert all(len(s) == 1 for s in got.values())
    for c in range(k):
        sign = None
        for i, x in fine:
            dev, w, share = next(iter(got[(i, c + 1)]))
            assert dev == sum((n * a - t) ** 2 for a, t in zip(x, total))
            want = float(np.dot([float(Fraction(a) - Fraction(t, n)) for a, t in zip(x, total)], vectors[:, c]) / math.sqrt(values[c]))
            sign = sign or math.copysign(1, w * want)
            assert abs(w - sign * want) < 1e-6
            assert abs(share - values[c] / values.sum()) < 1e-6 * share + 1e-12
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-8


def test_polarisation_is_exact(spark):
    """Whole numbers of any size give the exact covariance, also where a long would overflow."""
    rng = np.random.default_rng(1)
    for size in (50, 2**33, 2**60):
        x = np.array([[int(c) for c in r] for r in rng.integers(-size, size, (40, 4))], np.int64)
        n, total = len(x), [int(sum(int(a) for a in c)) for c in x.T]
        whole, rest = [t // n for t in total], tuple(t % n for t in total)
        squares = [int(q) for q in wh.polarised_squares(wh._centred(x, np.array(whole, np.int64)))]
        y = [[n * int(a) - t for a, t in zip(r, total)] for r in x]
        assert wh.covariance(squares, n, rest) == [[Fraction(sum(r[a] * r[b] for r in y), n**3) for b in range(4)] for a in range(4)]


def test_small_eigenvalues_keep_relative_precision():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    want = np.geomspace(1, 1e-13, 12)
    v = [[sum(Fraction(float(q[a, i])) * Fraction(float(want[i])) * Fraction(float(q[b, i])) for i in range(12)) for b in range(12)] for a in range(12)]
    e, axes, trace = wh.eigen(v)
    left = axes.T @ axes - np.eye(12)
    assert np.abs(left).max() < 1e-14 and np.all(np.abs(e / want - 1) < 1e-4) and abs(trace - want.sum()) < 1e-12


def test_large_values(spark):
    """Deviations outside a long are null, whitened values are right all the same."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 3)) * [1e8, 1.0, 1e4]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    out = result(spark, rows)
    assert all(r.deviation is None for r in out if r.component == 1) and out[0].identity_error < 1e-4 and len(out) == 180


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.5]), (2, [0.0, 2.0]), (3, [4.0, 1.0])]
    odd = [(4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (10, [1.0, 2.0, 3.0])]
    assert {r.vec_id for r in result(spark, good + odd)} == {1, 2, 3}
    assert result(spark, []) == [] and result(spark, odd[:4]) == [] and result(spark, good[:1] * 3) == [] and result(spark, [(8, [])]) == []
    # Dimensions that depend on each other have fewer components; a constant one has none.
    out = result(spark, [(i, [float(i % 5), 2.0 * (i % 5), 3.0]) for i in range(20)])
    assert {r.component for r in out} == {1} and len(out) == 20 and out[0].n == 5 and abs(out[0].explained - 1) < 1e-9


def test_whole_table(spark):
    from lexiforge.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    out = QUERIES["op12_whitening"](spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, total, cov, fine = brute(rows)
    assert len(out) == 16 * len(fine) and out[0].n == n and out[0].identity_error < 1e-8
    dev = {i: sum((n * a - t) ** 2 for a, t in zip(x, total)) for i, x in fine}
    assert all(r.deviation == dev[r.vec_id] for r in out)
    values = np.linalg.eigvalsh(np.array(cov, float))[::-1]
    assert all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 for r in out)
