"""Language identification by a bidirectional gated recurrent network over bytes (operator 6).

A text's UTF-8 bytes are cut into windows; one gated recurrent cell reads a window
forwards, one backwards, and a softmax over both states labels every byte position. The
document's probabilities are the mean over all its positions, so every byte of a text
counts, whatever its length.

Training is numpy backpropagation through time on a bounded sample of labelled rows:
``per_language`` windows of each language (``Settings``), drawn by a hash of text and
window number over whole texts; the bound is on the fitting only. Scoring runs in Arrow
batches on whole texts with a model of a few kilobytes.

Defined results: null text and text without a letter get ``und`` and score 0; null
``lang`` rows are not learned from; with no labelled row every text is ``und``; a repeated
row gets the same result; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import release

UND = "und"


@dataclass(frozen=True)
class Settings:
    """``window``: bytes per window when scoring; ``train_window``: code points when fitting;
    ``per_language``: most windows learned from per language; ``max_languages``: more distinct
    labels than this raise an error."""

    hidden: int = 8
    window: int = 128
    train_window: int = 48
    per_language: int = 1200
    max_languages: int = 256
    epochs: int = 8
    batch: int = 128
    rate: float = 0.02
    seed: int = 7


@dataclass
class Network:
    """Weights: per direction (0 forwards, 1 backwards) an input table by byte (2, 256, 3H),
    the recurrent matrix (2, H, 3H) with column blocks reset, update, candidate, and the
    output matrix (2, H, L) with bias (L)."""

    langs: list[str]
    table: np.ndarray
    rec: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _squash(x):
    """The cell's activation, x / (1 + |x|): bounded like tanh at a fifth of its cost."""
    return x / (1 + np.abs(x))


def _gate(x):
    return 0.5 + 0.5 * _squash(x)


def forward(net: Network, data: np.ndarray):
    """States (T+1, 2, B, H) and gates of windows ``data`` (B, T); direction 1 reads from the end."""
    b, t = data.shape
    h = net.rec.shape[1]
    both = np.stack([data.T, data.T[::-1]], axis=1)  # (T, 2, B)
    states = np.zeros((t + 1, 2, b, h), net.rec.dtype)
    gates = np.empty((t, 4, 2, b, h), net.rec.dtype)
    for i in range(t):
        x = np.stack([net.table[0][both[i, 0]], net.table[1][both[i, 1]]])
        rh = states[i] @ net.rec
        r = _gate(x[..., :h] + rh[..., :h])
        z = _gate(x[..., h : 2 * h] + rh[..., h : 2 * h])
        n = _squash(x[..., 2 * h :] + r * rh[..., 2 * h :])
        states[i + 1] = n + z * (states[i] - n)
        gates[i, 0], gates[i, 1], gates[i, 2], gates[i, 3] = r, z, n, rh[..., 2 * h :]
    return both, states, gates


def loss_gradients(net: Network, data: np.ndarray, mask: np.ndarray, target: np.ndarray):
    """Mean cross-entropy over the positions of ``mask`` (B, T) and the gradients of all
    weights by backpropagation through time."""
    h, (b, t) = net.rec.shape[1], data.shape
    both, states, gates = forward(net, data)
    fwd, bwd = states[1:, 0], states[1:, 1][::-1]  # (T, B, H) aligned by position
    logits = fwd @ net.out[0] + bwd @ net.out[1] + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    m = mask.T[:, :, None] / mask.sum()
    loss = -float((np.log(p[:, np.arange(b), target] + 1e-12) * m[..., 0]).sum())
    d = p
    d[:, np.arange(b), target] -= 1
    d *= m
    g_out = np.stack([np.einsum("tbh,tbl->hl", fwd, d), np.einsum("tbh,tbl->hl", bwd, d)])
    g_bias = d.sum(axis=(0, 1))
    d_state = np.stack([d @ net.out[0].T, (d @ net.out[1].T)[::-1]], axis=1)  # (T, 2, B, H)
    g_table, g_rec = np.zeros_like(net.table), np.zeros_like(net.rec)
    carry = np.zeros((2, b, h), net.rec.dtype)
    for i in range(t - 1, -1, -1):
        r, z, n, rn = gates[i]
        dh = carry + d_state[i]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        dz = dh * (states[i] - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dn * rn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        dx = np.concatenate([dr, dz, dn], axis=-1)
        drh = np.concatenate([dr, dz, dn * r], axis=-1)
        g_rec += np.swapaxes(states[i], 1, 2) @ drh
        carry = dh * z + drh @ np.swapaxes(net.rec, 1, 2)
        for side in (0, 1):
            np.add.at(g_table[side], both[i, side], dx[side])
    return loss, [g_table, g_rec, g_out, g_bias]


def train(windows: list[bytes], labels: list[str], s: Settings = Settings()) -> Network | None:
    """Adam on shuffled batches; equal input in equal order gives an equal network."""
    if not windows:
        return None
    langs = sorted(set(labels))
    rng = np.random.default_rng(s.seed)
    size = max(map(len, windows))
    data, mask = np.zeros((len(windows), size), np.uint8), np.zeros((len(windows), size), np.float32)
    for i, w in enumerate(windows):
        data[i, : len(w)] = np.frombuffer(w, np.uint8)
        mask[i, : len(w)] = 1
    target = np.array([langs.index(x) for x in labels])
    h = s.hidden
    net = Network(langs, *(rng.normal(0, sd, shape).astype(np.float32) for sd, shape in (
        (0.3, (2, 256, 3 * h)), (0.3, (2, h, 3 * h)), (0.3, (2, h, len(langs))), (0.0, (len(langs),)))))
    params = [net.table, net.rec, net.out, net.bias]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    batches = -(-len(windows) // s.batch) * s.epochs
    for _ in range(s.epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), s.batch):
            pick = order[at : at + s.batch]
            _, grads = loss_gradients(net, data[pick], mask[pick], target[pick])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = s.rate * (1 - 0.9 * step / batches)
            for p, g, a, b in zip(params, grads, m1, m2):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


class Scorer:
    """Pooled probabilities of whole texts; states of many windows go step by step together."""

    LANES = 1024

    def __init__(self, net: Network, window: int):
        self.net, self.window = net, window
        # Lanes run along the last axis, so that every step works on whole rows.
        self.table = np.ascontiguousarray(np.swapaxes(net.table, 1, 2))
        self.rec = np.ascontiguousarray(np.swapaxes(net.rec, 1, 2))
        self.out = np.ascontiguousarray(np.swapaxes(net.out, 1, 2))

    def windows(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Windows of a text and the first position of each that counts: the last window
        ends with the text and overlaps the one before."""
        t, n = self.window, len(raw)
        a = np.frombuffer(raw, np.uint8)
        k = -(-n // t)
        if n < t:
            return np.pad(a, (0, t - n))[None], np.zeros(1, np.int64)
        starts = np.minimum(np.arange(k) * t, n - t)
        return a[starts[:, None] + np.arange(t)], np.arange(k) * t - starts

    def lanes(self, data: np.ndarray, skip: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Sum over positions [skip, upto) of each window's probabilities, (B, L)."""
        net, h, t = self.net, self.net.rec.shape[1], self.window
        b = len(data)
        cols = np.ascontiguousarray(data.T).astype(np.intp)
        logits = np.empty((t, len(net.langs), b), np.float32)
        for side, order in ((0, range(t)), (1, range(t - 1, -1, -1))):
            table, rec, out = self.table[side], self.rec[side], self.out[side]
            state = np.zeros((h, b), np.float32)
            x, rh, tmp = (np.empty((3 * h, b), np.float32) for _ in range(3))
            for i in order:
                np.take(table, cols[i], axis=1, out=x, mode="clip")
                np.matmul(rec, state, out=rh)
                gate, n = x[: 2 * h], x[2 * h :]
                gate += rh[: 2 * h]
                den = np.abs(gate, out=tmp[: 2 * h])
                den += 1
                gate /= den
                gate += 1
                gate *= 0.5
                cand = rh[2 * h :]
                cand *= gate[:h]
                n += cand
                den = np.abs(n, out=tmp[2 * h :])
                den += 1
                n /= den
                state -= n
                state *= gate[h:]
                state += n
                if side:
                    logits[i] += out @ state
                else:
                    np.add(out @ state, net.bias[:, None], out=logits[i])
        np.exp(logits, out=logits)
        at = np.arange(t)[:, None]
        counted = ((at >= skip) & (at < upto)) / logits.sum(axis=1)
        return np.einsum("tlb,tb->bl", logits, counted.astype(np.float32)).astype(np.float64)

    def score(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities per text, (n, L); a text without bytes gets zeros."""
        out = np.zeros((len(texts), len(self.net.langs)))
        held: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        count, sizes = 0, np.zeros(len(texts))

        def flush():
            nonlocal held, count
            if not held:
                return
            data = np.concatenate([x[1] for x in held])
            skip = np.concatenate([x[2] for x in held])
            upto = np.concatenate([np.full(len(x[1]), x[3]) for x in held])
            doc = np.concatenate([np.full(len(x[1]), x[0]) for x in held])
            for a in range(0, len(data), self.LANES):
                part = slice(a, a + self.LANES)
                np.add.at(out, doc[part], self.lanes(data[part], skip[part], upto[part]))
            held, count = [], 0

        for i, text in enumerate(texts):
            raw = text.encode("utf-8", "replace")
            sizes[i] = len(raw)
            # A very long text goes in by blocks of whole windows, so memory stays bounded.
            block = self.window * self.LANES * 4
            for a in range(0, len(raw), block):
                piece = raw[a : a + block]
                data, skip = self.windows(piece)
                held.append((i, data, skip, min(len(piece), self.window)))
                count += len(data)
                if count >= 4 * self.LANES:
                    flush()
        flush()
        return out / np.maximum(sizes, 1)[:, None]


def letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sample_windows(labelled: DataFrame, s: Settings) -> tuple[list[bytes], list[str]]:
    """At most ``per_language`` windows (text, lang) of each language, the ones of the smallest
    hash over all windows of all texts with a letter; the driver gets nothing else."""
    x = labelled.where(F.col("lang").isNotNull() & letters(F.col("text"))).select("text", "lang")
    counts = x.groupBy("lang").agg(F.count("*").alias("n")).limit(s.max_languages + 1).collect()
    if len(counts) > s.max_languages:
        raise ValueError(f"more than {s.max_languages} labels in lang")
    if not counts:
        return [], []
    # A draw of about twice the bound from each language first (several windows of a text where
    # texts are few), so that only that much is ranked.
    many = {r["lang"]: min(64, -(-2 * s.per_language // r["n"])) for r in counts}
    share = {r["lang"]: 2.0 * s.per_language / (r["n"] * many[r["lang"]]) for r in counts}

    def by_lang(d):
        return F.element_at(F.create_map(*[c for k, v in d.items() for c in (F.lit(k), F.lit(v))]), F.col("lang"))

    x = x.withColumn("_i", F.explode(F.sequence(F.lit(1), by_lang(many))))
    h = F.xxhash64(F.lit(s.seed), "_i", "text")
    unit = F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(2**53))
    x = x.withColumn("_h", h).where(unit < by_lang(share))
    at = F.pmod(F.xxhash64("_h"), F.greatest(F.char_length("text") - s.train_window + 1, F.lit(1))).cast("int") + 1
    x = x.select("lang", "_h", F.substring("text", at, F.lit(s.train_window)).alias("w"))
    x = x.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy("_h", "w"))).where(F.col("_r") <= s.per_language)
    rows = x.orderBy("lang", "_h", "w").select("lang", "w").collect()
    return [r["w"].encode("utf-8", "replace") for r in rows], [r["lang"] for r in rows]


def fit(labelled: DataFrame, s: Settings = Settings()) -> Network | None:
    return train(*sample_windows(labelled, s), s)


_SCORERS: dict[int, Scorer] = {}


def predict(docs: DataFrame, net: Network | None, s: Settings = Settings()) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (any columns of these names are replaced)."""
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(UND), "score": F.lit(0.0)})
    langs = net.langs

    @F.pandas_udf("struct<lang_pred string, score double>")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(net, s.window)
        for texts in parts:
            p = scorer.score([t if t is not None else "" for t in texts])
            best = p.argmax(axis=1) if len(p) else np.empty(0, np.int64)
            score = np.clip(p[np.arange(len(p)), best], 0.0, 1.0)
            yield pd.DataFrame({"lang_pred": [langs[i] for i in best], "score": score})
        release()

    got = docs.withColumn("_lid", label("text"))
    ok = letters(F.col("text"))
    return got.withColumns({
        "lang_pred": F.when(ok, F.col("_lid.lang_pred")).otherwise(F.lit(UND)),
        "score": F.when(ok, F.col("_lid.score")).otherwise(F.lit(0.0)),
    }).drop("_lid")


def held_out(doc_id: Column, mod: int = 4, rest: int = 2) -> Column:
    """crc32 of the id's text mod ``mod`` is ``rest``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))
