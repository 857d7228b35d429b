import numpy as np
import pytest
from conftest_llm import brute_components

from lexiforge.llm import embed_lsh as el


def planted(rng, groups, size, noise, dim=32):
    base = rng.normal(size=(groups, dim))
    v = np.repeat(base, size, axis=0) + rng.normal(size=(groups * size, dim)) * noise
    return np.concatenate([v, rng.normal(size=(80, dim))])


@pytest.mark.parametrize("block", [256, 8])
def test_equals_brute_force(spark, block):
    """A hot group of near copies, exact copies, scaled copies; also with tiny blocks."""
    rng = np.random.default_rng(1)
    v = np.concatenate([planted(rng, 6, 5, 0.1), planted(rng, 1, 60, 0.05)[:60]])
    v = np.concatenate([v, v[:3], v[:1] * 7.0, np.repeat(v[40:41], 20, axis=0)])
    ids = rng.permutation(len(v)) * 3
    df = spark.createDataFrame([(int(i), [float(x) for x in r], 1, "own") for i, r in zip(ids, v)], "vec_id long, embedding array<double>, label int, rep string")
    out = {r.vec_id: r for r in el.near_duplicates(df, el.Settings(block=block)).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(len(v), dtype=bool)
    label = brute_components(ids.tolist(), [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(near))])
    found, total = 0, 0
    for k, i in enumerate(ids.tolist()):
        assert out[i].n_links <= near[k].sum()
        found, total = found + out[i].n_links, total + near[k].sum()
        assert out[i].component_id == label[i] and out[i].kept == (label[i] == i)
    assert found >= 0.99 * total


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine just above 0.9, the hardest to meet."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = 0.9001
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([a, c * a + np.sqrt(1 - c * c) * b]))]
    out = el.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in out) >= 0.9 * 600 and all(r.n_links <= 1 for r in out)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
            (9, [1.0]), (10, [1e-300, 0.0]), (11, [1e300, 0.0]), (12, [-1.0, 0.0]), (None, [1.0, 0.0])]
    out = {}
    for r in el.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        out.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    assert out[1] == [(4, 1)] and out[2] == [(4, 1)] * 2 and out[10] == out[11] == [(4, 1)]
    assert all(out[d] == [(0, d)] for d in (3, 4, 5, 6, 7, 8, 9, 12)) and out[None] == [(0, None)]
    assert el.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
