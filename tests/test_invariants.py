"""Properties of the random operators under their keyed draws, and invariants of the
pretraining records."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.functions.rng import py_randint, py_u
from lexiforge.operators import masking, sequences


def test_plan_properties():
    """Every plan covers its document from the first sentence on, in chunks that reach the
    target or the end, cut inside the chunk; a random next puts back what follows the cut."""
    rng, seed = random.Random(7), 11
    for doc in range(300):
        lens = np.array([rng.randint(1, 40) for _ in range(rng.randint(1, 60))])
        rows = sequences.walk_document(lens, doc, 3, 50, seed, 125, 0.3)
        for rep in range(3):
            chunks = [r[2:6] for r in rows if r[0] == rep]
            target = py_randint(2, 125, seed, "target", rep, doc) if py_u(seed, "short", rep, doc) < 0.3 else 125
            at = 0
            for start, end, cut, is_random in chunks:
                n = end - start + 1
                assert start == at and lens[start:end].sum() < target and (end == len(lens) - 1 or lens[start : end + 1].sum() >= target)
                assert cut == (1 if n == 1 else py_randint(1, n - 1, seed, "cut", rep, doc, start))
                assert is_random == (n == 1 or py_u(seed, "next", rep, doc, start) < 0.5)
                at = start + cut if is_random else end + 1
            assert at == len(lens)


def test_truncated_pairs_are_slices_of_the_right_lengths(spark):
    rng = random.Random(3)
    rows = [(k, list(range(rng.randint(1, 150))), list(range(1000, 1000 + rng.randint(1, 150)))) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, a array<int>, b array<int>")
    a, b = sequences.truncate_pair_random("a", "b", 125, 5, [F.col("k")])
    fronts = 0
    for r in df.select("k", "a", "b", a.alias("x"), b.alias("y")).collect():
        over = max(0, len(r.a) + len(r.b) - 125)
        # The longer side gives first; at equal lengths the second one does, so they alternate.
        from_a = max(0, len(r.a) - len(r.b)) if len(r.a) > len(r.b) else 0
        from_b = max(0, len(r.b) - len(r.a))
        if over <= from_a + from_b:
            want = (len(r.a) - (over if from_a else 0), len(r.b) - (over if from_b else 0))
        else:
            rest = over - from_a - from_b
            want = (len(r.a) - from_a - rest // 2, len(r.b) - from_b - (rest + 1) // 2)
        assert (len(r.x), len(r.y)) == want
        assert r.x == r.a[r.x[0] : r.x[0] + len(r.x)] and r.y == r.b[r.y[0] - 1000 : r.y[0] - 1000 + len(r.y)]
        fronts += r.x[0] > 0
    assert fronts > 50


def test_masking_kernel(spark):
    """Positions, shares and labels against the same draws taken one by one."""
    from lexiforge.functions import rng

    rows = [(k, [4] + [10 + i % 40 for i in range(n)] + [5]) for k, n in enumerate([1, 3, 20, 60, 125] * 30)]
    df = spark.createDataFrame(rows, "k long, ids array<int>")
    one = [rng.mix32(rng.h32(9, p, F.col("k")), F.col("p")).alias(p) for p in masking.PURPOSES]
    slow = df.select("k", F.posexplode("ids").alias("p", "id")).select("k", "p", "id", *one).collect()
    kern = masking.mask_instances(F.col("ids"), masking.draws(9, F.col("k")), 4, 5, 6, list(range(100, 150)), 0.15, 20)
    by = {}
    for r in slow:
        by.setdefault(r.k, []).append(r)
    kinds = {"mask": 0, "same": 0, "word": 0}
    for r in df.select("k", "ids", kern.alias("m")).collect():
        cand = sorted((x for x in by[r.k] if x.id not in (4, 5)), key=lambda x: (x.cand, x.p))
        k = min(20, max(1, int(np.rint(len(r.ids) * 0.15))))
        want = {x.p: 6 if x.mask80 < 0.8 * 2**32 else x.id if x.mask50 < 0.5 * 2**32 else 100 + int(x.maskw / 2**32 * 50) for x in cand[:k]}
        assert r.m.pos == sorted(want) and r.m.lab == [r.ids[p] for p in r.m.pos]
        assert r.m.out_ids == [want.get(p, x) for p, x in enumerate(r.ids)]
        for p, v in want.items():
            kinds["mask" if v == 6 else "same" if v == r.ids[p] else "word"] += 1
    n = sum(kinds.values())
    assert abs(kinds["mask"] / n - 0.8) < 0.05 and abs(kinds["same"] / n - 0.1) < 0.05


def test_pretraining_invariants_and_partition_independence(spark):
    from lexiforge.plans.catalog import load_all

    q, _ = load_all()
    sf = "/root/testdata/sf0.001"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = q["f19_pretraining_records"](spark, sf)
        ra = sorted((r.inst_index, tuple(r.input_ids), tuple(r.masked_lm_positions)) for r in a.collect())
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        b = q["f19_pretraining_records"](spark, sf)
        rb = sorted((r.inst_index, tuple(r.input_ids), tuple(r.masked_lm_positions)) for r in b.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert ra == rb
    for r in a.collect():
        n = sum(r.input_mask)
        assert len(r.input_ids) == 128 and len(r.masked_lm_positions) == 20
        k = int(sum(r.masked_lm_weights))
        assert k == min(20, max(1, int(np.rint(n * 0.15))))
        assert all(0 < p < n for p in r.masked_lm_positions[:k])
        assert r.input_ids[0] == 4


@pytest.mark.parametrize("block", [13, 40, sequences.BLOCK_SENTENCES])
def test_plan_equals_single_walk(spark, block):
    """Any block size gives the plan of the loop over each whole document."""
    from lexiforge.plans import q_corpus as Q
    from lexiforge.plans.pretraining import PretrainingConfig, sentence_ids

    sf = "/root/testdata/sf0.001"
    sents = Q.doc_sentences(spark, sf)
    from lexiforge.operators import vocab as V

    docs, s, d, words = sentence_ids(sents, V.word_vocab(sents, 500), 12345)
    n_docs = docs.count()
    got = sorted(map(tuple, sequences.plan_chunks(s, n_docs, 3, 12345, 16, 0.3, block_sentences=block).collect()), key=repr)
    lens = {}
    for r in s.select("doc_index", "sent_no", "n_tokens").orderBy("doc_index", "sent_no").collect():
        lens.setdefault(r.doc_index, []).append(r.n_tokens)
    assert max(map(len, lens.values())) > 40
    want = [row for doc, x in lens.items() for row in sequences.walk_document(np.array(x), doc, 3, n_docs, 12345, 13, 0.3)]
    assert got == sorted((tuple(None if v is None else int(v) if not isinstance(v, bool) else v for v in row) for row in want), key=repr)


def test_two_level_running_sum_equals_single_window(spark):
    from lexiforge.functions.indexing import exclusive_running_sum, ordered_running_sum

    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("part"), F.lit("").alias("file"),
                                  (F.col("id") % 13).alias("v"))
    a = {(r.part, r.o) for r in exclusive_running_sum(df, ["part", "file"], "v", "o").collect()}
    b = {(r.part, r.o) for r in ordered_running_sum(df, ["part", "file"], "v", "o").collect()}
    assert a == b


def test_planner_keeps_blocks_whole(spark):
    """The sentences of a block come together, with no join that Spark could broadcast instead of bringing them there."""
    rng = np.random.default_rng(3)
    lens = {d: rng.integers(1, 9, 60 + d).tolist() for d in range(40)}
    rows = [(d, i, n, len(x)) for d, x in lens.items() for i, n in enumerate(x)]
    s = spark.createDataFrame(rows, "doc_index long, sent_no long, n_tokens int, n_sent long").repartition(8)
    plan = sequences.plan_chunks(s, 40, 2, 12345, 16, 0.3, block_sentences=20)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, plan.collect()), key=repr)
    want = [row for doc, x in lens.items() for row in sequences.walk_document(np.array(x), doc, 2, 40, 12345, 13, 0.3)]
    assert got == sorted(map(tuple, want), key=repr)


def test_masking_takes_the_least_draws(spark):
    """Chosen positions are the candidates of least draw, for instances of any length in one batch."""
    rows = [(k, [4, *range(100, 100 + n), 5]) for k, n in enumerate((0, 1, 3, 40, 126, 2, 126))]
    x = spark.createDataFrame(rows, "k long, ids array<int>").withColumn("base", masking.draws(9, F.col("k")))
    got = x.withColumn("m", masking.mask_instances(F.col("ids"), F.col("base"), 4, 5, 6, list(range(100, 150)), 0.15, 20)).collect()
    for r in got:
        draw = {p: int(masking._mix32_np(np.array([r.base[0]]), np.array([p]))[0]) for p, i in enumerate(r.ids) if i not in (4, 5)}
        k = min(20, max(1, int(np.rint(len(r.ids) * 0.15))))
        assert r.m.pos == sorted(sorted(draw, key=lambda p: (draw[p], p))[:k])
        assert r.m.lab == [r.ids[p] for p in r.m.pos] and len(r.m.out_ids) == len(r.ids)
        assert all(a == b for p, (a, b) in enumerate(zip(r.ids, r.m.out_ids)) if p not in r.m.pos)
