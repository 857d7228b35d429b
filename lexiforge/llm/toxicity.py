"""Toxicity by subword-bag embeddings averaged into a linear softmax (operator 2).

A word is the bag of its character n-grams (with end marks) and itself, each hashed to a row
of an embedding table; its vector is their mean, so a misspelling shares most of
its n-grams with the word it stands for. A passage's vector is the sum of its
distinct words' vectors over its word count (a word said fifty times says no more than
once, so junk that repeats a word is not toxic for it) and a linear softmax labels it; table and softmax are trained jointly in numpy. A document is
as toxic as its worst passage, so a few words in a long text are not averaged away: labels
are of documents, and in each epoch a document stands by its worst passage so far (in the first
ones by the passage whose words are most typical of toxic documents, by a test of shares).

The model is linear after the mean, so scoring needs one number per distinct word; a
passage is a mean of them. Every word of every text is scored. Fitting uses a bounded
sample of labelled rows (``Settings.per_class`` documents of each label, drawn by a hash of
the id among texts of at most ``max_train_chars``).

Defined results: null, empty or word-less text is scored by the bias alone (as a passage
without words); rows without a label are not learned from; a document with several
labels counts as toxic if one says so; without both classes every score is the share of toxic
labels (0 if none); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dim: int = 8
    least: int = 3
    most: int = 5
    passage: int = 24
    per_class: int = 3000
    max_train_chars: int = 60_000
    epochs: int = 8
    least_steps: int = 800
    guided_epochs: int = 3
    batch: int = 64
    rate: float = 0.5
    seed: int = 11


@dataclass
class Model:
    """``value``: by bucket, the difference of the two class scores of its embedding;
    ``bias``: the difference of the class biases."""

    value: np.ndarray
    bias: float


STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str) -> list[str]:
    """Lower-cased white-space words, bare of punctuation around them."""
    return [w for w in (x.strip(STRIP) for x in text.lower().split()) if w]


def grams(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word and of the word itself, flat, with the
    starts of the words. Hashes are polynomial over code points, whole arrays at a time."""
    coded = [np.frombuffer(("<" + w + ">").encode("utf-32-le", "replace"), np.uint32) for w in words]
    sizes = np.array([len(c) for c in coded])
    flat = np.concatenate(coded).astype(np.uint64) if len(coded) else np.empty(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = sizes[owner] - (np.arange(len(flat)) - starts[owner])  # code points from here to the word's end
    hashes, owners = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, s.most + 1):
        h = h[: len(flat) - n + 1] * np.uint64(1000003) + flat[n - 1 :]
        if n >= s.least:
            ok = left[: len(h)] >= n
            hashes.append((h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15))
            owners.append(owner[: len(h)][ok])
    power = np.cumprod(np.full(int(sizes.max()) if len(sizes) else 1, 1000003, np.uint64))
    place = np.arange(len(flat)) - starts[owner]
    whole = np.add.reduceat(flat * power[place], starts) if len(words) else np.empty(0, np.uint64)
    hashes.append((whole + np.uint64(99)) * np.uint64(0xC2B2AE3D27D4EB4F))
    owners.append(np.arange(len(words)))
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    count = np.bincount(o, minlength=len(words))
    return ((h[order] >> np.uint64(40)) % np.uint64(s.buckets)).astype(np.int64), np.cumsum(count) - count


def passage_means(words: np.ndarray, value: np.ndarray, passage: int) -> np.ndarray:
    """Sum of ``value`` (by word) over the distinct words of each passage, over its words."""
    at = np.arange(len(words)) // passage
    _, first = np.unique(at * (int(words.max()) + 1) + words, return_index=True)
    total = np.bincount(at[first], weights=value[first])
    return total / np.bincount(at)


def train(texts: list[str], toxic: list[int], s: Settings = Settings()) -> Model:
    """Stochastic gradient descent, table and softmax together; equal input gives an equal model."""
    y_doc = np.asarray(toxic, np.int64)
    if not len(texts) or y_doc.min() == y_doc.max():
        p = float(y_doc.mean()) if len(y_doc) else 0.0
        return Model(np.zeros(s.buckets, np.float32), float(np.log((p + 1e-9) / (1 - p + 1e-9))))
    rng = np.random.default_rng(s.seed)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int32) for t in texts]
    blocks, names = [], list(vocab)
    for at in range(0, len(names), 20_000):  # n-grams of some words at a time
        b, first = grams(names[at : at + 20_000], s)
        blocks.append((b.astype(np.int32), np.diff(np.append(first, len(b)))))
    bucket, size = (np.concatenate([b[i] for b in blocks]) for i in (0, 1))
    end = np.cumsum(size)
    start, words = end - size, len(names)
    del vocab, names, blocks
    table = rng.uniform(-1.0 / s.dim, 1.0 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    soft, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
    g_soft, g_bias, largest = np.full(soft.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32), 0.0
    counts = [max(1, -(-len(d) // s.passage)) for d in docs]
    # How far the share of toxic documents that hold a word lies above the others', in deviations.
    held = [np.bincount(np.concatenate([np.unique(d) for d, y in zip(docs, y_doc) if y == c] or [np.empty(0, np.int32)]), minlength=words) for c in (0, 1)]
    n = np.bincount(y_doc, minlength=2)
    pooled = (held[0] + held[1] + 1) / (n.sum() + 2)
    typical = np.maximum(held[1] / n[1] - held[0] / n[0], 0) ** 2 / (pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    # Few documents go round more often, so that every model gets ``least_steps`` steps.
    for epoch in range(max(s.epochs, -(-s.least_steps * s.batch // len(docs)))):
        worth = typical if epoch < s.guided_epochs else np.add.reduceat((table @ (soft[:, 1] - soft[:, 0]))[bucket], start) / (end - start)
        pick = []
        for i, d in enumerate(docs):
            if not len(d):
                pick.append((i, 0, 0))
                continue
            if counts[i] > 1:
                v = worth[d]
                best = int(np.argmax(passage_means(d, v, s.passage)))
                pick.append((i, best * s.passage, min(len(d), (best + 1) * s.passage)))
                if not y_doc[i]:
                    k = int(rng.integers(counts[i]))
                    pick.append((i, k * s.passage, min(len(d), (k + 1) * s.passage)))
            else:
                pick.append((i, 0, len(d)))
        order = rng.permutation(len(pick))
        for at in range(0, len(order), s.batch):
            rows = [pick[j] for j in order[at : at + s.batch]]
            size = np.array([b - a for _, a, b in rows])
            y = y_doc[[i for i, _, _ in rows]]
            word = np.concatenate([docs[i][a:b] for i, a, b in rows]) if size.sum() else np.empty(0, np.int64)
            distinct = np.unique(np.repeat(np.arange(len(rows)), size) * words + word)
            passage, word = distinct // words, distinct % words
            n = end[word] - start[word]
            owner = np.repeat(np.arange(len(word)), n)
            at_gram = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + start[word][owner] if len(word) else np.empty(0, np.int64)
            b = bucket[at_gram]
            share = (1.0 / n[owner] / size[passage[owner]]).astype(np.float32) if len(word) else np.empty(0, np.float32)
            hidden = np.zeros((len(rows), s.dim), np.float32)
            np.add.at(hidden, passage[owner], table[b] * share[:, None])
            logit = hidden @ soft + bias
            logit -= logit.max(axis=1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(axis=1, keepdims=True)
            d = p
            d[np.arange(len(y)), y] -= 1
            d_hidden = d @ soft.T
            gs, gb = hidden.T @ d / len(y), d.mean(axis=0)
            g_soft += gs * gs
            g_bias += gb * gb
            uniq, where = np.unique(b, return_inverse=True)
            g = np.zeros((len(uniq), s.dim), np.float32)
            np.add.at(g, where, d_hidden[passage[owner]] * share[:, None])
            # One step size for the whole table: what rarely occurs moves little, so the words
            # that happen to stand beside toxic ones are not learned by heart.
            largest = max(largest * 0.98, float(np.abs(g).max()) if len(g) else 0.0)
            if largest:
                table[uniq] -= s.rate * g / largest
            soft -= s.rate * gs / np.sqrt(g_soft)
            bias -= s.rate * 0.2 * gb / np.sqrt(g_bias)
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Score of whole texts; one cached number per distinct word."""

    CACHE = 400_000

    def __init__(self, model: Model, s: Settings):
        self.model, self.s = model, s
        self.known: dict[str, int] = {}
        self.value = np.empty(0)

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):  # some MB of text at a time
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < 4_000_000):
                size += len(texts[to])
                to += 1
            lists = [words_of(t) for t in texts[at:to]]
            if len(self.known) > self.CACHE:
                self.known, self.value = {}, np.empty(0)
            known = self.known
            new = list({w for ws in lists for w in ws if w not in known})
            if new:
                bucket, start = grams(new, self.s)
                value = np.add.reduceat(self.model.value[bucket], start) / np.diff(np.append(start, len(bucket)))
                known.update(zip(new, range(len(known), len(known) + len(new))))
                self.value = np.concatenate([self.value, value])
            for k, ws in enumerate(lists):
                if not ws:
                    out[at + k] = self.model.bias
                    continue
                ids = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
                out[at + k] = passage_means(ids, self.value[ids], self.s.passage).max() + self.model.bias
            at = to
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def held_out(doc_id: Column, mod: int = 5, rest: int = 0) -> Column:
    """crc32 of the id's text mod ``mod`` is ``rest``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``per_class`` labelled rows of each class (``labels``:
    doc_id, toxic), of the smallest hash of their id."""
    lab = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    h = F.xxhash64(F.lit(s.seed), "doc_id")
    unit = F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(2**53))
    n = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n:
        return [], []
    rate = F.when(F.col("toxic") == 1, F.lit(2.0 * s.per_class / max(1, n.get(1, 0)))).otherwise(F.lit(2.0 * s.per_class / max(1, n.get(0, 0))))
    few = lab.withColumn("_h", h).where(unit < rate)
    few = few.withColumn("_r", F.row_number().over(W.partitionBy("toxic").orderBy("_h", "doc_id")))
    few = few.where(F.col("_r") <= s.per_class).select("doc_id", "toxic", "_h")  # at most twice ``per_class`` rows
    rows = docs.select("doc_id", "text").where(F.coalesce(F.char_length("text"), F.lit(0)) <= s.max_train_chars).join(
        F.broadcast(few), "doc_id").orderBy("toxic", "_h", "doc_id", "text").select("text", "toxic").collect()
    return [r["text"] or "" for r in rows], [r["toxic"] for r in rows]


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    return train(*sample(docs, labels, s), s)


def score(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # half a megabyte, whatever the input

    @F.pandas_udf("double")
    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value, s)
        for texts in parts:
            yield pd.Series(scorer.score([t if t is not None else "" for t in texts]), dtype="float64")

    out = docs.withColumn("score", toxic("text"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
