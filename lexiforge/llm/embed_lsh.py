"""Embedding near-duplicates by Euclidean p-stable hashing (operator 4).

Normalised vectors are hashed by quantised random projections, ``floor((a . v + b) / width)``,
``projections`` of them joined into a bucket key, in ``tables`` independent tables; vectors
that share a bucket in any table are compared by exact cosine in double precision.

* Vectors with equal components are one class, compared once, counted by size.
* A bucket of many classes is cut into blocks, and its block pairs are spread over tasks, so
  no bucket is gathered; every pair of a bucket is compared, none is capped.
* A pair that meets in several tables is counted in the first of them: hashes are
  computed again from the vectors of a block, in a fixed order of additions, so that every
  task gets the same bits.
* Links are not written out: a block pair returns, per class, how many vectors it
  links with, and a spanning forest of its links.

At the production setting a pair at exactly the threshold 0.9 meets with probability 0.95, at
0.95 with more than 0.999.

Defined results: vectors that are null, of zero norm, or hold null or non-finite components
link with nothing and are their own component; vectors of different lengths never link; rows
that repeat a ``vec_id`` are separate vectors and link like others; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut_lineage, parallelism, star_forest


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.9
    tables: int = 24
    projections: int = 8
    width: float = 1.5
    block: int = 256
    seed: int = 5


def normalised(v: np.ndarray) -> np.ndarray:
    """Rows over their norms, by a scale first so that tiny and huge vectors do not vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(_dot(v, v))[:, None]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


_PROJECTIONS: dict = {}


def bucket_keys(unit: np.ndarray, s: Settings) -> np.ndarray:
    """(n, tables) int64 keys; additions run dimension by dimension, so a vector's key does
    not depend on the rows that it is computed with."""
    key = (unit.shape[1], s)
    if key not in _PROJECTIONS:
        rng = np.random.default_rng([s.seed, unit.shape[1]])
        n = s.tables * s.projections
        mix = rng.integers(0, 1 << 63, s.projections, dtype=np.int64) | 1
        _PROJECTIONS[key] = rng.normal(size=(unit.shape[1], n)), rng.uniform(0, s.width, n), mix
    a, b, mix = _PROJECTIONS[key]
    total = np.broadcast_to(b, (len(unit), len(b))).copy()
    for d in range(unit.shape[1]):
        total += unit[:, d, None] * a[d]
    cells = np.floor(total / s.width).astype(np.int64).reshape(len(unit), s.tables, s.projections)
    h = np.zeros(cells.shape[:2], np.int64)
    for j in range(s.projections):
        h = (h ^ cells[:, :, j]) * mix[j]
        h ^= (h >> 31) & 0x1FFFFFFFF
    return h


def hashed(classes: DataFrame, s: Settings) -> DataFrame:
    """(rep, m, dim, v binary double, t, key) per class and table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby(b["embedding"].str.len()):
                unit = normalised(np.array(part["embedding"].to_list(), np.float64))
                keys = bucket_keys(unit, s)
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "m": part["m"].to_numpy(), "dim": int(dim),
                                    "v": [u.tobytes() for u in unit], "keys": list(keys)})

    x = classes.mapInPandas(run, "rep long, m long, dim int, v binary, keys array<long>")
    return x


def _compare(rows: pd.DataFrame, s: Settings) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links found in one block pair: (kind, id, value) arrays; kind 0 is a count of linked
    vectors, kind 1 a spanning link."""
    rows = rows.sort_values("rep", kind="stable")
    t, own = int(rows["t"].iloc[0]), bool((rows["bi"] == rows["bj"]).iloc[0])
    unit = np.frombuffer(b"".join(rows["v"]), np.float64).reshape(len(rows), -1)
    side = (rows["side"] == 0).to_numpy()
    rep, m = rows["rep"].to_numpy(), rows["m"].to_numpy()
    ia = np.arange(len(rows)) if own else np.flatnonzero(side)
    ib = ia if own else np.flatnonzero(~side)
    if not len(ia) or not len(ib):
        return []
    near = (unit[ia] @ unit[ib].T) >= s.threshold - 1e-9
    if own:
        near = np.triu(near, 1)
    i, j = (x[k] for x, k in zip((ia, ib), np.nonzero(near)))
    if not len(i):
        return []
    exact = _dot(unit[i], unit[j]) >= s.threshold
    i, j = i[exact], j[exact]
    if t and len(i):  # counted in the first table where both share a bucket
        keys = bucket_keys(unit, s)[:, :t]
        new = np.ones(len(i), bool)
        for c in range(t):
            new &= keys[i, c] != keys[j, c]
        i, j = i[new], j[new]
    if not len(i):
        return []
    linked = np.zeros(len(rows), np.int64)
    np.add.at(linked, i, m[j])
    np.add.at(linked, j, m[i])
    label = star_forest(len(rows), i, j)
    child = np.flatnonzero(label != np.arange(len(rows)))
    some = np.flatnonzero(linked)
    return [(np.zeros(len(some), np.int32), rep[some], linked[some]), (np.ones(len(child), np.int32), rep[child], rep[label[child]])]


def _links(placed: DataFrame, s: Settings) -> DataFrame:
    key = ["dim", "t", "key", "bi", "bj"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            arr = b[key].to_numpy()
            edge = np.flatnonzero((arr[1:] != arr[:-1]).any(axis=1)) + 1
            bounds = np.concatenate(([0], edge))
            out = []
            for lo, hi in zip(bounds, bounds[1:]):  # the last group may go on in the next batch
                if hi - lo > 1:
                    out += _compare(b.iloc[lo:hi], s)
            rest = b.iloc[bounds[-1] :]
            if out:
                yield pd.DataFrame({c: np.concatenate([o[k] for o in out]) for k, c in enumerate(("kind", "id", "value"))})
        if rest is not None and len(rest) > 1:
            out = _compare(rest, s)
            if out:
                yield pd.DataFrame({c: np.concatenate([o[k] for o in out]) for k, c in enumerate(("kind", "id", "value"))})

    x = placed.repartition(parallelism(placed.sparkSession), *key).sortWithinPartitions(*key)
    return x.mapInPandas(run, "kind int, id long, value long")


def near_duplicates(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding)."""
    e = F.col("embedding")
    fine = e.isNotNull() & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(e, lambda c: c != 0)
    ok = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    x = vectors.select("vec_id", F.when(ok, e).alias("embedding"))
    classes = x.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    # A class is known by its smallest id; rows that repeat an id with other components would
    # share it, so classes of one id are told apart by a hash of their components.
    classes = classes.withColumn("cls", F.xxhash64("embedding", "rep"))
    classes = cut_lineage(classes)
    h = cut_lineage(hashed(classes.select(F.col("cls").alias("rep"), "m", "embedding"), s))
    keyed = h.select("rep", "dim", F.posexplode("keys").alias("t", "key"))
    size = keyed.groupBy("dim", "t", "key").agg(F.count("*").alias("n")).where("n > 1")
    hits = keyed.join(size, ["dim", "t", "key"]).withColumn("g", F.ceil(F.col("n") / F.lit(s.block)).cast("int"))
    hits = hits.withColumn("b", F.pmod(F.xxhash64("rep", "t"), F.col("g")).cast("int"))
    # Row of block b: the pairs (b, j) for j >= b as side 0 and (i, b) for i < b as side 1.
    hits = hits.withColumn("o", F.explode(F.expr("sequence(0, g - 1)"))).select(
        "rep", "dim", "t", "key", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), (F.col("b") > F.col("o")).cast("int").alias("side"))
    placed = hits.join(h.select("rep", "m", "v"), "rep")
    found = cut_lineage(_links(placed, s))
    counts = found.where("kind = 0").groupBy("id").agg(F.sum("value").alias("links"))
    comp = components(found.where("kind = 1").select(F.col("id").alias("a"), F.col("value").alias("b")))
    per = classes.select("cls", "rep", "m", "embedding").join(counts, F.col("cls") == F.col("id"), "left").drop("id")
    per = per.join(comp, F.col("cls") == F.col("node"), "left").drop("node")
    low = per.where("component is not null").groupBy("component").agg(F.min("rep").alias("low"))
    per = per.join(low, "component", "left").select("embedding", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("low", "rep").alias("component_id"))
    per = per.withColumn("_h", F.xxhash64("embedding")).alias("r")
    left = x.withColumn("_h", F.xxhash64("embedding")).alias("l")
    out = left.join(per, (F.col("l._h") == F.col("r._h")) & (F.col("l.embedding") == F.col("r.embedding")), "left").select(
        "l.vec_id", F.coalesce("r.n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("r.component_id", "l.vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def oracle(s: Settings = Settings()) -> str:
    """DuckDB SQL by comparing all pairs: what the search finds if it misses none."""
    return f"""
WITH RECURSIVE vecs AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (
  SELECT r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM vecs
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b, a.vec_id AS av, b.vec_id AS bv FROM fine a JOIN fine b ON a.r <> b.r AND len(a.e) = len(b.e)
    AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {s.threshold}),
reach AS (
  SELECT a, b, bv FROM links UNION SELECT reach.a, links.b, links.bv FROM reach JOIN links ON links.a = reach.b),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
low AS (SELECT a, min(bv) AS m FROM reach GROUP BY a)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(l.m, v.vec_id)) AS component_id,
  v.vec_id IS NOT DISTINCT FROM least(v.vec_id, coalesce(l.m, v.vec_id)) AS kept
FROM vecs v LEFT JOIN counts c ON c.a = v.r LEFT JOIN low l ON l.a = v.r"""
