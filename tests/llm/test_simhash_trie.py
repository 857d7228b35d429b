import random

import numpy as np
import pytest
import xxhash
from conftest_llm import brute_components
from lexiforge.llm import simhash_trie as st


def plain_simhash(text, n=3):
    if text is None:
        return 0
    table = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(table))
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    out = 0
    for b in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s.encode(), seed=42) >> b & 1 for s in sh) > len(sh):
            out |= 1 << b
    return out


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "É é x\x0by\x0cz  q", "x " * 500, "Straße \x1c mit\x85Zeichen und\xa0mehr"])
def test_fingerprint(text):
    assert st.simhash(text) & (2**64 - 1) == plain_simhash(text)


def test_long_text_goes_in_whole(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdef") for _ in range(5000))
    want = plain_simhash(text)
    monkeypatch.setattr(st, "CHUNK", 7)
    assert st.simhash(text) & (2**64 - 1) == want


def test_walk_equals_all_pairs():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 60):
        keys = rng.integers(0, 2**63, 8, dtype=np.uint64)
        keys = np.unique(np.concatenate([k ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) for k in keys]))
        one = np.zeros(1, np.int64)
        i, j = st.walk(keys, one, one + len(keys), one, one + len(keys), one, one, 3)
        d = np.bitwise_count(keys[:, None] ^ keys[None]) <= 3
        assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if d[a, b]]


@pytest.mark.parametrize("most", [st.MAX_PAIRS, 20])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, most):
    """Also with so small a limit that node pairs are opened again and again."""
    monkeypatch.setattr(st, "MAX_PAIRS", most)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(25)]
    fps = set()
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    got = [(r.a, r.b) for r in st.trie_links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    assert brute_components(fps, got) == brute_components(fps, near)
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 64 for a, b in got) and len(got) <= 4 * len(fps) * 16


def test_components_and_edge_rows(spark, frame):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text), (3, text), (3, text), (9, text + " end"), (None, text), (7, None), (8, ""), (6, "other words entirely here"), (2**62, "x")]
    out = {}
    for r in st.simhash_components(frame(rows, "fp component rep node")).collect():
        out.setdefault(r.doc_id, []).append(r.component_id)
    assert out[3] == [3, 3] and out[5] == [3] and out[None] == [3] and out[7] == out[8] == [7]
    fp = {d: plain_simhash(t) for d, t in rows}
    assert out[9] == [3 if bin(fp[9] ^ fp[3]).count("1") <= 3 else 9]
    kept = st.keep_first(frame(rows, "fp component rep"))
    assert kept.columns[-1] == "rep" and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.text == text) == [3, 3]
    assert st.simhash_components(frame([])).count() == 0 and st.keep_first(frame([])).count() == 0
