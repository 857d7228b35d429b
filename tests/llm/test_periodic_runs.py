import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lexiforge.llm import periodic_runs as pr


def brute_runs(w, least=24):
    """(start, length, period) by start, then period, straight from the definition."""
    found = {}
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - p:
            s = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, 3 * p):
                found.setdefault((s, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_row(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    drop = set()
    for s, length, q in runs:
        drop.update(range(s + q, s + length))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def texts(rng, many):
    out = []
    for _ in range(many):
        n, k = rng.randint(0, rng.choice([5, 60, 200])), rng.choice([1, 2, 3, 50])
        t = [rng.randrange(k) for _ in range(n)]
        while n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
            for i in range(a + p, a + rng.randint(1, n - a)):
                if i < n:
                    t[i] = t[i - p]
        out.append(t)
    return out


@pytest.mark.parametrize("least", [3, 5, 24])
def test_search_equals_brute_force(least):
    rng = random.Random(least)
    for _ in range(300):
        batch = texts(rng, rng.randint(1, 6))
        rows = pr._documents([None] * len(batch), [" ".join(map(str, t)).encode() for t in batch], least, None)
        for t, r in zip(batch, rows):
            got = list(zip(r[1].tolist(), r[2].tolist(), r[3].tolist()))
            assert got == sorted(brute_runs(t, least), key=lambda x: (x[0], x[2]))


def test_extensions_equal_comparison():
    """Across texts, with repeats longer than many moduli."""
    rng = random.Random(4)
    long_ = [rng.randrange(4) for _ in range(300)]
    batch = [long_ + [9] + long_, [1] * 400, long_, [rng.randrange(2) for _ in range(500)], [3]]
    words = np.array([w for t in batch for w in t])
    text = np.repeat(np.arange(len(batch)), [len(t) for t in batch])
    ext = pr.Extensions(words, text)
    i, j = np.array([p for p in (sorted(rng.sample(range(len(words)), 2)) for _ in range(6000)) if text[p[0]] == text[p[1]]]).T
    got = ext.lce(i, j)
    for a, b, k in zip(i, j, got):
        end = np.flatnonzero(text == text[a])[-1] + 1
        want = 0
        while b + want < end and words[a + want] == words[b + want]:
            want += 1
        assert k == want


def test_cover_holds_every_difference():
    assert {(int(a) - int(b)) % pr.MODULUS for a in pr.COVER for b in pr.COVER} == set(range(pr.MODULUS))


def test_grid_chunks_hold_every_pair(monkeypatch):
    monkeypatch.setattr(pr, "GRID_ROWS", 7)
    p, g = np.array([1, 2, 9, 40]), np.array([3, 1, 4, 2])
    got = sorted((int(a), int(b)) for i, q, _ in pr._grid(p, g, 30) for a, b in zip(i, q))
    assert got == sorted((i, int(a)) for a, b in zip(p, g) for i in range(0, 30 - int(a), int(b)))


def test_rows_equal_brute_force(spark, frame):
    """Planted tails, runs, repeated rows and ids, nulls, other white space, words of other scripts."""
    rng = random.Random(8)
    rows = [(i, " ".join(map(str, t))) for i, t in enumerate(texts(rng, 60))]
    rows += [(0, rows[0][1]), (100, None), (101, ""), (102, " \t\n\x0b\x0c\r "), (103, "ü é x " * 30), (104, "a b\tc\n" * 9),
             (105, "x " * 23), (106, "x " * 24), (None, "y z " * 20), (107, "w" * 100000), (2**62 + 1, "a b c " * 12), (108, "k\x1cl " * 30),
             (109, "a b " * 20 + "q " + "c d e " * 30 + "f " * 40)]
    df = frame(rows, "runs starts collapsed n_words start length period")
    got = [tuple(r) for r in pr.digests(pr.find_runs(df, edit=pr.planted_tail)).collect()]
    key = lambda r: tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted((brute_row(d, t) for d, t in rows), key=key)
    assert sum(r[1] for r in got) > 20 and any(r[1] > 1 for r in got)


def test_general_interface(spark, frame):
    r = pr.find_runs(frame([(1, "p " + "a b c " * 4 + "a q r")]), least=9).collect()[0]
    assert [tuple(x) for x in r.runs] == [(1, 13, 3)] and r.collapsed == "p a b c q r" and r.n_words == 16
    assert pr.find_runs(frame([])).count() == 0 and pr.digests(pr.find_runs(frame([]))).count() == 0


def test_long_texts_end():
    """One word over and over, and a long period, in a text of 100,000 words."""
    for period in (1, 1000):
        w = [b"%d" % (i % period) for i in range(100_000)]
        n, s, length, p, kept = pr._documents(["1"], [b" ".join(w)], 24, None)[0]
        assert (s.tolist(), length.tolist(), p.tolist()) == ([0], [100_000], [period]) and kept.split() == w[:period]


def test_whole_table_equals_brute_force(spark):
    """The query over the smallest table, against the definition."""
    from lexiforge.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        if len((d.text or "").split()) < 2500:  # the definition takes the square of the words
            assert got[d.doc_id] == brute_row(d.doc_id, d.text)
