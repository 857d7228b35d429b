import random
import zlib

import numpy as np
import pytest

from lexiforge.llm import pack_bestfit as pb

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [c for c in left if c >= n]
        if fit:
            c = min(fit)
            left.remove(c)
            left.append(c - n)
        else:
            left.append(capacity - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 128])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 4)), capacity // 3 or 1]) for _ in range(rng.randint(0, 400))]
    hist = {n: lengths.count(n) for n in set(lengths)}
    bins, seen = {}, {n: set() for n in hist}
    for length, first, count, bin_, offset in pb.plan(hist, capacity):
        for k in range(count):
            assert bins.get(bin_ + k, 0) == offset  # gapless
            bins[bin_ + k] = offset + length
            assert first + k not in seen[length]
            seen[length].add(first + k)
    assert {n: len(s) for n, s in seen.items()} == hist
    assert sorted(capacity - v for v in bins.values()) == brute_fit(lengths, capacity)


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    rng = random.Random(1)
    atoms = [" ", "  ", "\n", "\t", "a", "B", "é", ".", "'s", "9", "\x1c", "\x85", "　", "<|endoftext|>", "日", "don't", "word"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    got = pb.encoder(PATH).encode(texts)
    assert got == [np.asarray(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_long_white_space():
    """Ids of long runs equal the tokenizer's, at every kind of end; 10 million blanks are encoded."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    n = pb.LONG_RUN
    runs = [" " * (n - 1), " " * n, " " * (n + 900), "\n" * n, " \n\t" * n, "\u3000" * n, "\x1c" * n, " " * n + "\n"]
    texts = [a + r + b for r in runs for a in ("", "x", "7 ", "<|endoftext|>") for b in ("", "y", ".", "'s", "<|endoftext|>", "\x1c")]
    texts.append("a" + " " * n + "b" + "\n" * n + "c")
    got = pb.encoder(PATH).encode_added(texts)
    assert got == [np.asarray(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert len(pb.encoder(PATH).encode_added(["a" + " " * 10_000_000 + "b"])[0]) == 4 * 10_000_001


def test_pieces_equal_the_tokenizer_as_it_is_loaded(spark, frame):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    atoms = [" ", "  ", "\n", "a", "é", ".", "'s", "9", "\x85", "　", "<|endoftext|>", "<|endoftext|", "|>", "日", "word", " next"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> ", *("".join(rng.choice(atoms) for _ in range(rng.randint(0, 40))) for _ in range(400))]
    ids = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert ids[0] == [64, 220, 50256, 275]
    out = {r.doc_id: r for r in pb.pieces(frame(list(enumerate(texts))), PATH).collect()}
    for i, one in enumerate(ids):
        raw = np.asarray([*one, pb.END_ID], "<u4").tobytes()
        assert (out[i].length, out[i].ids_crc32) == (len(one) + 1, zlib.crc32(raw))


def test_documents(spark, frame):
    rng = random.Random(2)
    texts = [" ".join("abcdefgh"[: rng.randint(1, 8)] for _ in range(rng.randint(0, 300))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, " ".join(str(i) for i in range(9000))), (3, texts[3]), (None, "no id")]
    out = pb.pack_documents(frame(rows, "length offset sequence_id piece start _rank"), PATH, capacity=64).collect()
    ids = {d: np.frombuffer(pb.encoder(PATH).encode([t or ""])[0], "<u4").tolist() + [0] for d, t in rows}
    places, pieces = {}, {}
    for r in out:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 64 and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert r.piece == 0 or r.length == 64
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 64
    for d, p in pieces.items():
        copies = 2 if d == 3 else 1
        assert sum(n for _, n in p) == copies * len(ids[d])
    assert len(places) == len(brute_fit([r.length for r in out], 64))
    assert pb.pack_documents(frame([]), PATH).count() == 0
