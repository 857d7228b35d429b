import hashlib
import random

import numpy as np
import pytest

from lexiforge.llm import ctph


def brute_signature(raw, size):
    """Byte by byte."""
    window, out, total, some = [0] * 7, "", 0, False
    for c in raw:
        window = window[1:] + [c]
        h = 0
        for x in window[::1]:
            h = (h * 0x01000193 + x) % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        h ^= h >> 13
        total, some = (total + h * 0x297A2D39) % 2**32, True
        if h % size == size - 1:
            out += chr(ctph.ALPHABET[((total ^ total >> 16) * 0x7FEB352D) % 2**32 >> 26])
            total, some = 0, False
    return out + (chr(ctph.ALPHABET[((total ^ total >> 16) * 0x7FEB352D) % 2**32 >> 26]) if some else "")


@pytest.mark.parametrize("step", [1 << 22, 13])
def test_signature(monkeypatch, step):
    monkeypatch.setattr(ctph, "STEP", step)
    rng = random.Random(1)
    for n in (1, 6, 7, 8, 50, 400):
        raw = bytes(rng.randrange(256) for _ in range(n))
        assert ctph._signature(np.frombuffer(raw, np.uint8), (4, 8)) == [brute_signature(raw, 4), brute_signature(raw, 8)]


def brute_likeness(a, b):
    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x):
            new = [i + 1]
            for j, d in enumerate(y):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (c != d)))
            row = new
        return row[-1]

    def sim(x, y):
        return 1 - lev(x, y) / max(len(x), len(y)) if x or y else 0.0

    (sa, a1, a2), (sb, b1, b2) = a.split(":"), b.split(":")
    sa, sb = int(sa), int(sb)
    if a == b:
        return 1.0
    if sa == sb:
        return max(sim(a1, b1), sim(a2, b2))
    return sim(a1, b2) if sa == 2 * sb else sim(a2, b1) if sb == 2 * sa else 0.0


def test_successors(spark, frame):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    ids = rng.sample(range(-50, 10_000), 60)
    rows = list(zip(ids, texts)) + [(20_000, None), (20_001, ""), (20_002, "é日" * 500), (20_003, "a" * 70_000)]
    rng.shuffle(rows)
    out = {r.doc_id: r for r in ctph.compare_successors(frame(rows, "fingerprint bucket guest _h first host")).collect()}
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: r[0])
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = out[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == ctph.fingerprint(t) and r.edited_fingerprint == ctph.fingerprint(edited)
        assert r.near_edited == pytest.approx(brute_likeness(r.fingerprint, r.edited_fingerprint), abs=1e-9)
        assert r.near_next == pytest.approx(brute_likeness(r.fingerprint, ctph.fingerprint(after)), abs=1e-9)
    some = [out[d] for d in ids if len(dict(rows)[d]) > 300]
    assert sum(r.near_edited > r.near_next + 0.2 for r in some) > 0.95 * len(some)


def test_long_repetitive_texts(spark, frame):
    """Texts of 5 MB that repeat a few bytes have short signatures, and comparing them ends."""
    import time

    for w in ("ab c", "x", "lorem ipsum ", "0123456789", "é", "abcdefg hijk ", "zq", "so so ", "na"):
        assert all(len(s) <= ctph.MOST for s in ctph.fingerprint((w * 60_000)[:60_000]).split(":")[1:])
    # One that hits the trigger at the text's own block size again and again.
    rng = random.Random(5)
    hot = next(w for w in ("".join(rng.choice("abcdefgh ") for _ in range(9)) for _ in range(100_000))
               if len(ctph._signature(np.frombuffer((w * 200).encode(), np.uint8), (1024,))[0]) > 150)
    rows = [(1, hot * 555_000), (2, hot * 500_000 + "end"), (3, "x" * 5_000_000)]
    start = time.time()
    out = {r.doc_id: r for r in ctph.compare_successors(frame(rows)).collect()}
    assert time.time() - start < 60
    assert all(len(s) <= ctph.MOST for r in out.values() for s in r.fingerprint.split(":")[1:])
    assert out[1].near_next == pytest.approx(brute_likeness(out[1].fingerprint, out[2].fingerprint), abs=1e-9)


def test_edge_rows(spark, frame):
    assert ctph.fingerprint("") == "4::"
    one = ctph.compare_successors(frame([(1, "only one here")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = [(1, "same"), (1, "same"), (1, "other text"), (None, "no id"), (None, None), (2, "two")]
    out = ctph.compare_successors(frame(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((d is None, d or 0) for d, _ in rows)
    assert ctph.compare_successors(frame([])).count() == 0
