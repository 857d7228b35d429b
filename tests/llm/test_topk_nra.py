import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import topk_nra as tk

SCHEMA = "vec_id long, embedding array<double>, label int, key string, score string"


def brute(rows, k=5, every=50):
    """(query_id, rank, vec_id, score) of all query rows, from all pairs, in whole numbers."""
    fine = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (qi, q) in enumerate(fine):
        if qi is None or qi % every:
            continue
        scores = [(-sum(x * y for x, y in zip(q, v)), i is None, i or 0, i) for b, (i, v) in enumerate(fine) if b != a and len(v) == len(q)]
        out += [(qi, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda t: t[:3])[:k])]
    return sorted(out, key=str)


def answer(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, 0, "own", "own") for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in tk.top_k(df, F.col("vec_id") % 50 == 0, tk.Settings(**settings)).collect()), key=str)


@pytest.mark.parametrize("settings", [{}, {"block": 4, "query_block": 3, "rounds": 2}])
def test_equals_brute_force(spark, settings):
    """Near copies, a hot vector, ties (few distinct values), in many small blocks too."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 16))
    v[100:160] = v[0] + rng.normal(size=(60, 16)) * 0.05
    v[200:290] = v[50]
    v[300:] = rng.integers(-1, 2, size=(100, 16)) / 256
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(400), v)]
    assert answer(spark, rows, **settings) == brute(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (0, [0.25, 0.0]), (50, None), (100, [nan, 1.0]), (150, [inf, 1.0]), (200, [None, 1.0]), (250, []), (251, []),
            (300, [1.0]), (1, [1.0, 0.5]), (None, [1.0, 0.5]), (None, [9.0, 9.0]), (2, [-0.001, 0.0]), (350, [2.0, 1.0, 0.0]), (-50, [1.0, -3.0])]
    assert answer(spark, rows) == brute(rows)
    assert answer(spark, []) == [] and answer(spark, [(50, [1.0])]) == [] and answer(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_scores_beyond_double_precision(spark):
    """Scores above 2^53 stay exact; a score outside a long is an error."""
    rows = [(0, [2.0**21, 1.0]), (1, [2.0**24, 1.0]), (2, [2.0**24, 1.0 + 1 / 256]), (3, [2.0**24, 1.0 + 2 / 256])]
    assert answer(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="outside the range"):
        answer(spark, [(0, [2.0**40]), (1, [2.0**40])])


def test_bounds_hold_and_reading_stops_early():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, size=(1024, 24))
    q = x[:20] + rng.integers(-9, 9, size=(20, 24))
    true = q @ x.T
    lists = tk.Lists(x.astype(float))
    for depth in (1, 7, 100, 1024):
        lists.read(depth)
        upper, lower = lists.bounds(q.astype(float))
        assert (lower <= true).all() and (true <= upper).all()
    assert (upper == true).all() and (lower == true).all()
    none = np.full(20, np.iinfo(np.int64).min)
    i, j, score, depth = tk.search_block(q, x, none, 1, tk.Settings())
    assert (score == true[i, j]).all() and all(true[a].argmax() in j[i == a] for a in range(20))
    assert depth.max() < 1024
    # A threshold from other blocks stops the reading where nothing can reach it.
    i, j, score, depth = tk.search_block(q, x, true.max(axis=1) * 2, 1, tk.Settings())
    assert not len(i) and depth.max() <= 256


def test_equals_sql(spark):
    import duckdb

    from lexiforge.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(ORACLES["op11_topk_nra"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["op11_topk_nra"](spark, sf).collect()) == sorted(want) and len(want) == 50
