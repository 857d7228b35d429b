"""Multiclass gradient boosting with early stopping by patience (K3).

Softmax loss, one regression tree per class and round, all classes grown together. Values are
binned once. A level of the trees is one job: each task adds up, per class, node, feature and bin, the
count, the gradients and the curvatures of its rows; sums of one class and node meet in one task, which
returns the best split, so the driver gets one row per class and node. After a round the
scores of all rows are written, and the loss of the validation rows decides whether to go on.

Defined results: a row without features counts as all zeros; labels are 0 to classes - 1; no validation
row means no early stop; ties between splits go to the lower feature, then the lower threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    patience: int = 5
    tol: float = 0.01


@dataclass
class Tree:
    """Nodes 0.. of a full binary tree (children of i: 2i + 1 and 2i + 2): a split ``value <= threshold`` goes
    left; ``feature`` -1 marks a leaf, ``bin`` is the threshold's place among the feature's edges."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))

    def nodes(self, x: np.ndarray, limit: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row of ``x`` after ``levels`` levels; a row stays at a leaf."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(levels):
            f = self.feature[at]
            right = x[rows, np.maximum(f, 0)] > limit[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def leaf_value(g: float, h: float, classes: int, rate: float) -> float:
    """Newton step of the softmax loss for summed gradients ``g`` and curvatures ``h``."""
    return 0.0 if h < 1e-12 else rate * (classes - 1) / classes * g / h


def histograms(bins: np.ndarray, zero: np.ndarray, node: np.ndarray, n_nodes: int, width: int, g: np.ndarray) -> np.ndarray:
    """(nodes, 3, features, bins) sums of 1, g and |g| (1 - |g|). Only values other than zero are visited; the bin
    of zero gets what the others leave of the node's total."""
    d = len(zero)
    row, col = np.nonzero(bins != zero)
    place = (node[row] * d + col) * width + bins[row, col]
    out = np.empty((n_nodes, 3, d, width))
    every = np.arange(d)
    for s, w in enumerate((np.ones(len(g)), g, np.abs(g) * (1 - np.abs(g)))):
        t = np.bincount(place, weights=w[row], minlength=n_nodes * d * width).astype(float).reshape(n_nodes, d, width)
        total = np.bincount(node, weights=w, minlength=n_nodes).astype(float)
        t[:, every, zero] += total[:, None] - t.sum(axis=2)
        out[:, s] = t
    return out


def best_split(h: np.ndarray) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """(feature, bin, gain, sums left, sums right) of one node's (3, features, bins); feature -1 where no split
    lowers the squared error of the gradients."""
    left = np.cumsum(h, axis=2)
    total = left[:, :1, -1:]
    right = total - left
    n_l, n_r = left[0], right[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[1] ** 2 / n_l + right[1] ** 2 / n_r - total[1] ** 2 / total[0]
    gain = np.where((n_l > 0.5) & (n_r > 0.5), gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(np.round(gain, 10))), gain.shape)
    if not gain[f, b] > 1e-9:
        return -1, 0, 0.0, total[:, 0, 0], np.zeros(3)
    return int(f), int(b), float(gain[f, b]), left[:, f, b], right[:, f, b]


@dataclass
class BoostedTrees:
    """A fitted model: starting scores, rounds of one tree per class, validation loss after each round."""

    start: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.repeat(self.start[None, :], len(x), axis=0)
        for trees in self.rounds:
            for k, t in enumerate(trees):
                depth = int(np.log2(len(t.feature) + 1)) - 1
                out[:, k] += t.leaf[t.nodes(x, t.threshold, depth)]
        return out

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``prediction`` (class of the highest score, ties to the lower) and ``probability`` (array)."""
        from pyspark.ml.functions import vector_to_array

        bc = df.sparkSession.sparkContext.broadcast(self)  # rounds x classes small trees

        @F.pandas_udf("prediction double, probability array<double>")
        def predict(s: pd.Series) -> pd.DataFrame:
            scores = bc.value.scores(np.array(s.to_list(), np.float64).reshape(len(s), -1))
            return pd.DataFrame({"prediction": scores.argmax(axis=1).astype(float), "probability": list(softmax(scores))})

        out = df.withColumn("_p", predict(vector_to_array(F.col(features))))
        return out.withColumns({"prediction": F.col("_p.prediction"), "probability": F.col("_p.probability")}).drop("_p")


def bin_edges(values: DataFrame, dims: int, bins: int) -> list[np.ndarray]:
    """Rising edges per feature: zero and quantiles of the other values, ``bins - 1`` at most. A value's bin is
    the number of edges below it."""
    shares = [float(q) for q in np.linspace(0, 1, bins - 1)[:-1]]
    e = values.select(F.posexplode("x").alias("f", "v")).where("v <> 0").groupBy("f").agg(F.percentile_approx("v", F.array(*map(F.lit, shares)), 10000).alias("q"))
    found = {r["f"]: r["q"] for r in e.collect()}  # features x bins
    return [np.unique(np.array([0.0, *found.get(f, [])])) for f in range(dims)]


def _level(state: DataFrame, trees: list[Tree], level: int, edges: list[np.ndarray], classes: int) -> list:
    """Best splits of all nodes of a level of the trees of all classes: one job."""
    zero = np.array([np.searchsorted(e, 0.0) for e in edges])
    width = max(len(e) for e in edges) + 1
    first, n_nodes = 2**level - 1, 2**level
    bc = state.sparkSession.sparkContext.broadcast((trees, zero))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown, z = bc.value
        total = np.zeros((classes, n_nodes, 3, len(z), width))
        for b in batches:
            b = b[~b["validation"]]
            if not len(b):
                continue
            x = np.frombuffer(b"".join(b["bins"]), np.uint8).reshape(len(b), -1)
            p = softmax(np.array(b["scores"].to_list(), np.float64))
            y = b["label"].to_numpy()
            for k, t in enumerate(grown):
                at = t.nodes(x, t.bin, level)
                on = at >= first
                total[k] += histograms(x[on], z, at[on] - first, n_nodes, width, ((y == k) - p[:, k])[on])
        some = [(k, v) for k in range(classes) for v in range(n_nodes) if total[k, v, 0].any()]
        yield pd.DataFrame({"k": [k for k, _ in some], "node": [v for _, v in some], "h": [total[k, v].tobytes() for k, v in some]})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for k, v, h in zip(b["k"], b["node"], b["h"]):
                h = np.frombuffer(h).reshape(3, len(zero), width)
                total[k, v] = h if (k, v) not in total else total[k, v] + h
        rows = [(k, v, *best_split(h)) for (k, v), h in total.items()]
        yield pd.DataFrame([(k, v, f, b, gain, left.tolist(), right.tolist()) for k, v, f, b, gain, left, right in rows],
                           columns=["k", "node", "feature", "bin", "gain", "lower", "upper"])

    parts = state.select("bins", "label", "validation", "scores").mapInPandas(sums, "k int, node int, h binary")
    best = parts.repartition(min(classes * n_nodes, 64), "k", "node").mapInPandas(
        split, "k int, node int, feature int, bin int, gain double, lower array<double>, upper array<double>")
    return best.collect()  # one row per class and node


def _grow(state: DataFrame, edges: list[np.ndarray], classes: int, s: Settings) -> list[Tree]:
    trees = [Tree.empty(s.depth) for _ in range(classes)]
    for level in range(s.depth):
        for r in _level(state, trees, level, edges, classes):
            t, v = trees[r["k"]], 2**level - 1 + r["node"]
            if r["feature"] < 0:
                t.leaf[v] = leaf_value(r["lower"][1], r["lower"][2], classes, s.rate)
                continue
            t.feature[v], t.bin[v], t.threshold[v] = r["feature"], r["bin"], edges[r["feature"]][r["bin"]]
            for child, sums in ((2 * v + 1, r["lower"]), (2 * v + 2, r["upper"])):
                t.leaf[child] = leaf_value(sums[1], sums[2], classes, s.rate)
    return trees


def stops(losses: list[float], patience: int, tol: float) -> bool:
    """Whether the last loss is not lower by ``tol`` than any of the ``patience`` losses before it."""
    return len(losses) > patience and losses[-1] + tol >= max(losses[-1 - patience : -1])


def fit(train: DataFrame, label_col: str = "label_index", features: str = "features", validation_col: str | None = None, s: Settings = Settings()) -> BoostedTrees:
    """Fit on the rows that are not for validation; stop by the loss of those that are."""
    from pyspark.ml.functions import vector_to_array

    held = F.lit(False) if validation_col is None else F.coalesce(F.col(validation_col), F.lit(False))
    x = cut_lineage(train.select(vector_to_array(F.col(features)).alias("x"), F.col(label_col).cast("int").alias("label"), held.alias("validation")).where("label is not null"))
    fitting = x.where("not validation")
    size = fitting.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).collect()  # one row per class
    if not size:
        raise ValueError("no row to fit on")
    classes = max(max(r["label"] for r in size) + 1, 2)
    share = np.zeros(classes)
    for r in size:
        share[r["label"]] = r["n"]
    with np.errstate(divide="ignore"):
        start = np.maximum(np.log(share / share.sum()), -30.0)
    edges = bin_edges(fitting, max(r["d"] for r in size), s.bins)
    first = start.tolist()

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.array(b["x"].to_list(), np.float64).reshape(len(b), -1)
            m = np.stack([np.searchsorted(e, v[:, f]) for f, e in enumerate(edges)], axis=1).astype(np.uint8) if len(b) else np.empty((0, 0), np.uint8)
            yield pd.DataFrame({"bins": [r.tobytes() for r in m], "label": b["label"], "validation": b["validation"], "scores": [first] * len(b)})

    schema = "bins binary, label int, validation boolean, scores array<double>"
    state = cut_lineage(x.mapInPandas(binned, schema))
    any_held = not x.where("validation").isEmpty()
    model = BoostedTrees(start)
    for _ in range(s.rounds):
        trees = _grow(state, edges, classes, s)
        model.rounds.append(trees)

        def add(batches: Iterator[pd.DataFrame], trees=trees) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    m = np.frombuffer(b"".join(b["bins"]), np.uint8).reshape(len(b), -1)
                    step = np.stack([t.leaf[t.nodes(m, t.bin, s.depth)] for t in trees], axis=1)
                    b["scores"] = list(np.array(b["scores"].to_list(), np.float64) + step)
                yield b

        state = cut_lineage(state.mapInPandas(add, schema))
        if not any_held:
            continue
        top = F.array_max("scores")
        norm = top + F.log(F.aggregate("scores", F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max("scores"))))
        loss = state.where("validation").agg(F.avg(norm - F.coalesce(F.try_element_at("scores", F.col("label") + 1), F.lit(-30.0)))).first()[0]
        model.losses.append(float(loss))
        if stops(model.losses, s.patience, s.tol):
            break
    return model
