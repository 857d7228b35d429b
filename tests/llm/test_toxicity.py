import random

import numpy as np
from pyspark.sql import functions as F

from lexiforge.llm import toxicity as tx

BAD = ["idiot", "moron", "worthless"]


def text(rng, bad, n):
    w = ["".join(rng.choice("aeioust") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    for _ in range(bad):
        w[rng.randrange(n)] = rng.choice(BAD)
    return " ".join(w)


def brute_grams(word, s):
    out = []
    marked = "<" + word + ">"
    for n in range(s.least, s.most + 1):
        for i in range(len(marked) - n + 1):
            h = 0
            for c in marked[i : i + n]:
                h = (h * 1000003 + ord(c)) % 2**64
            out.append(((h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % s.buckets)
    h = sum(ord(c) * pow(1000003, k + 1, 2**64) for k, c in enumerate(marked)) % 2**64
    return sorted(out + [((h + 99) * 0xC2B2AE3D27D4EB4F % 2**64 >> 40) % s.buckets])


def test_grams():
    s = tx.Settings()
    words = ["a", "idiot", "été", "日本語", "x" * 50]
    bucket, start = tx.grams(words, s)
    for w, a, b in zip(words, start, [*start[1:], len(bucket)]):
        assert sorted(bucket[a:b].tolist()) == brute_grams(w, s)


def test_learns_and_scores(spark, frame):
    rng = random.Random(1)
    rows, lab = [], []
    for i in range(1200):
        bad = rng.random() < 0.3
        rows.append((i, text(rng, 3 * bad, rng.choice([20, 100, 900]))))
        lab.append((i, int(bad)))
    docs, labels = frame(rows, "score predicted toxic _r _h"), spark.createDataFrame(lab, "doc_id long, toxic int")
    held = tx.held_out(F.col("doc_id"))
    s = tx.Settings(epochs=8)
    model = tx.fit(docs.where(~held), labels.where(~held), s)
    out = {r.doc_id: r for r in tx.score(docs.select("doc_id", "text"), model, s).collect()}
    test = [r.doc_id for r in docs.where(held).select("doc_id").collect()]
    assert np.mean([out[d].predicted == dict(lab)[d] for d in test]) > 0.95
    seen = tx.Scorer(model, s)
    assert seen.score(["aeio idi0t sust idiott oust"])[0] > seen.score(["aeio ista sust oust tius"])[0]
    # One number per word gives the same as the network's own passage vectors.
    t = rows[7][1]
    w = tx.words_of(t)
    best = -1e9
    for a in range(0, len(w), s.passage):
        part = w[a : a + s.passage]
        best = max(best, sum(np.mean(model.value[brute_grams(x, s)]) for x in set(part)) / len(part))
    assert abs(out[7].score - 1 / (1 + np.exp(-best - model.bias))) < 1e-4


def test_edge_rows(spark, frame):
    docs = frame([(1, None), (2, ""), (3, " .,; "), (4, "idiot " * 20_000), (4, "idiot " * 20_000), (None, "fine words")])
    labels = spark.createDataFrame([(2, 0), (4, 1), (4, 0), (None, 1), (1, None), (77, 1)], "doc_id long, toxic int")
    model = tx.fit(docs, labels, tx.Settings(epochs=1))
    out = tx.score(docs.select("doc_id", "text"), model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert all(r.score < 0.5 for r in tx.score(docs.select("doc_id", "text"), tx.fit(docs, labels.limit(0))).collect())
    assert tx.score(frame([]), model).count() == 0
