import random

import numpy as np
from pyspark.sql import functions as F

from lexiforge.llm import langid_gru as lg


def text(rng, lang, n):
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ei", "ung"], "cc": ["çã", "êt", "où"]}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    net = lg.Network(["a", "b", "c"], rng.normal(0, 0.5, (2, 256, 9)), rng.normal(0, 0.5, (2, 3, 9)), rng.normal(0, 0.5, (2, 3, 3)), rng.normal(0, 0.5, 3))
    data, mask = rng.integers(97, 101, (4, 6)).astype(np.uint8), np.ones((4, 6))
    mask[1, 3:] = 0
    target = np.array([0, 1, 2, 1])
    _, grads = lg.loss_gradients(net, data, mask, target)
    for p, g in zip((net.table, net.rec, net.out, net.bias), grads):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(25)] + ([(0, 97, 4), (1, 98, 7)] if p.ndim == 3 and p.shape[1] == 256 else []):
            old, e = p[at], 1e-6
            p[at] = old + e
            up = lg.loss_gradients(net, data, mask, target)[0]
            p[at] = old - e
            down = lg.loss_gradients(net, data, mask, target)[0]
            p[at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 1e-5


def brute_score(net, raw, window):
    if len(raw) < window:
        parts = [(raw + bytes(window - len(raw)), 0, len(raw))]
    else:
        starts = [min(k, len(raw) - window) for k in range(0, len(raw), window)]
        parts = [(raw[a : a + window], k - a, window) for a, k in zip(starts, range(0, len(raw), window))]
    total = np.zeros(len(net.langs))
    for part, lo, hi in parts:
        _, states, _ = lg.forward(net, np.frombuffer(part, np.uint8)[None])
        logits = states[1:, 0, 0] @ net.out[0] + states[1:, 1, 0][::-1] @ net.out[1] + net.bias
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        total += p[lo:hi].sum(axis=0)
    return total / len(raw)


def test_learns_and_scores_whole_texts(spark, frame):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randint(5, 60)), lang, "s") for i, lang in enumerate(rng.choice(["aa", "bb", "cc"]) for _ in range(300))]
    docs = frame(rows, "score lang_pred _row _i _h w")
    s = lg.Settings(window=16, train_window=24, per_language=200, epochs=4)
    net = lg.fit(docs.where(~lg.held_out(F.col("doc_id"))), s)
    out = lg.predict(docs.where(lg.held_out(F.col("doc_id"))), net, s).collect()
    assert len(out) > 40 and np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    scorer = lg.Scorer(net, 16)
    scorer.LANES = 3  # several blocks of windows and of long texts
    texts = [r[1] for r in rows[:20]] + ["a", "ka", "k" * 16, text(rng, "cc", 400)]
    for t, p in zip(texts, scorer.score(texts)):
        want = brute_score(net, t.encode(), 16)
        # A text beyond one block is windowed block by block.
        if len(t.encode()) <= 16 * 3 * 4:
            assert np.allclose(p, want, atol=1e-4)
        assert abs(p.sum() - 1) < 1e-4
    assert lg.fit(docs, s).table.tobytes() == lg.fit(docs.repartition(3), s).table.tobytes()


def test_edge_rows(spark, frame):
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "123 .,!", "bb"), (4, "ka to mi", None), (5, "ka to mi", "aa"), (5, "ka to mi", "aa"), (None, "sch ei", "bb")]
    docs = frame(rows, "_lid")
    net = lg.fit(docs.where(~lg.held_out(F.col("doc_id"))), lg.Settings(epochs=1))
    out = lg.predict(docs.drop("_lid"), net).collect()
    assert len(out) == 7
    for r in out:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in (1, 2, 3)) and (r.lang_pred in ("aa", "bb", "und"))
    none = lg.fit(frame([]))
    assert none is None and lg.predict(docs, none).select("lang_pred").distinct().collect()[0][0] == "und"
    assert lg.predict(frame([]), net).count() == 0
