import random
from collections import defaultdict

import pytest

from lexiforge.llm import pareto_mix as pm


def brute_targets(size, weights=(5, 2, 1), most=3):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = sum(size.values()), {}, set(order)
    while open_:  # share, cap, share the excess again
        left = total - sum(target.values())
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * size[s]]
        if not over:
            target.update({s: level * w[s] for s in open_})
            break
        for s in over:
            target[s] = most * size[s]
            open_.remove(s)
    return target


def test_targets_and_taken(spark, frame):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), None, rng.choice(["é", "z", "A", None, "hot", "hot", "hot", "tiny"][: 7 + (i < 3)])) for i in range(900)]
    out = pm.mix(frame(rows, "size copies u rank"), ).collect()
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len(t.split())
    want = brute_targets(size)
    taken, longest = defaultdict(int), defaultdict(int)
    by_id = {r[0]: r for r in rows}
    for r in out:
        t, s = by_id[r.doc_id][1], by_id[r.doc_id][3]
        assert r.size == len(t.split()) and r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    assert len(out) == 900 and all(abs(taken[s] - want[s]) <= longest[s] for s in want)
    again = {(r.doc_id, r.taken) for r in pm.mix(frame(rows[::-1])).repartition(5).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}


def test_edge_rows(spark, frame):
    rows = [(1, None, None, "a"), (2, "", None, "a"), (None, "x y", None, None), (None, "x y", None, None), (4, "one two three", None, "b"), (4, "one two three", None, "b")]
    df = frame(rows, "size row copies own")
    out = pm.mix(df).collect()
    assert len(out) == 6 and {r.taken for r in out if r.size == 0} == {0}
    assert len({r.taken for r in out if r.doc_id == 4}) == 1
    mixed = pm.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)
    assert {r["own"] for r in mixed.collect()} <= {"own own"}
    assert pm.mix(frame([])).count() == 0 and pm.mixed(frame([])).count() == 0


def test_unequal_weights(spark, frame):
    from pyspark.sql import functions as F

    df = frame([(i, "a b c d", None, "s") for i in range(200)] + [(1000 + i, "a b c d", None, "t") for i in range(200)])
    df = df.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    got = defaultdict(int)
    for r in pm.mix(df, weight="quality").collect():
        got[r.source, r.doc_id % 2] += r.taken
    assert got["s", 0] > 1.8 * got["s", 1] and got["t", 0] > 1.8 * got["t", 1]


def test_running_sums_get_even_ranges(spark, frame, monkeypatch):
    """A source capped at three copies draws nothing; the others' ranges are evenly filled."""
    seen = []
    sums = pm.running_sums

    def spy(df, group, unit, *rest):
        seen.extend((r.source, r.unit) for r in df.selectExpr("source", f"{unit} as unit").collect())
        return sums(df, group, unit, *rest)

    monkeypatch.setattr(pm, "running_sums", spy)
    rows = [(i, "w" if i % 3 == 0 else "w " * 30, None, "abc"[i % 3]) for i in range(1200)]
    out = pm.mix(frame(rows)).collect()
    capped = {r.source for r in out if r.target == 3 * r.source_size}
    assert capped and all(r.copies == 3 for r in out if r.source in capped) and not capped & {s for s, _ in seen}
    for s in {"a", "b", "c"} - capped:
        units = [u for t, u in seen if t == s]
        assert len(units) == 400 and max(sum(i / 10 <= u < (i + 1) / 10 for u in units) for i in range(10)) < 80
