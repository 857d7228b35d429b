"""Exact top-k by inner product with sorted lists only (operator 11): no-random-access aggregation.

The score of a candidate is the sum over dimensions of query times component, so each dimension is a
list sorted by its component, read from the end that helps the query. Candidates are cut into
blocks, each with its own sorted lists. In a block:

* All lists are read in rounds, a quarter of their entries in each. What has not been read of a
  candidate is bounded by the list: no more than the value that the reading has reached (upper bound of
  the score), no less than the list's last value (lower bound).
* The k-th greatest lower bound, or the k-th score of the blocks read before, is a threshold. A query
  stops when few candidates have an upper bound that reaches it; all others cannot qualify. (To settle an
  eighth of a block costs less than another round over all of it.)
* Those few get their final scores, and the best k stay. At full depth both bounds are the score, so
  every query stops.

Bounds of a block of queries are matrix products over the values read so far. All values are whole
numbers below 2^53 in double precision, or Python integers where a score could pass that, so scores are
exact.

Work at scale: every query meets every block of candidates (the query set is fixed, not a join of the table with
itself). Blocks of queries and slices of candidates make a grid; a task takes one cell, holds
one block of queries, and reads its slice block by block, so memory is bounded, the threshold rises along the
slice, and only k rows of a query leave a cell. Of candidates with equal vectors only the k + 1
smallest ids can be in an answer, so a hot vector is cut to these before it is dealt out; queries with equal
vectors are answered once.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of
another length than the query are no candidates; rows that repeat an id are separate rows and each
answered; a row without an id is a candidate after all ids among ties, and no query; an empty vector
scores 0 with other empty vectors; components whose scaled value is outside a long, and scores outside a long, are an
error; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, parallelism, release


@dataclass(frozen=True)
class Settings:
    k: int = 5
    scale: int = 256
    query_block: int = 4096  # queries of a task
    block: int = 1024  # candidates whose lists are read together
    rounds: int = 4  # in which all lists of a block would be read
    few: float = 0.125  # a query stops when no more than this share of a block is left (k candidates at least)


def usable(e: Column) -> Column:
    """Whether a vector is not null and holds finite numbers only."""
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(e.isNotNull() & ~bad, F.lit(False))


def scaled(e: Column, scale: int) -> Column:
    """The vector as array<long> of ``floor(scale * component)``."""
    return F.transform(e, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


class Lists:
    """The sorted lists of a block of candidates (rows of ``x``) and what has been read of them.

    A list is read from its top for queries that are positive there, from its bottom for the others. A value not
    read yet is bounded by the value that the reading has reached and by the other end of the list."""

    def __init__(self, x: np.ndarray):
        self.n, self.depth = len(x), 0
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)
        self.column = np.arange(x.shape[1])
        low, high = self.sorted[:1], self.sorted[-1:]
        # (most, least) that a candidate's component can help a positive query, and a negative one.
        self.top = [np.repeat(high, self.n, axis=0), np.repeat(low, self.n, axis=0)]
        self.bottom = [np.repeat(low, self.n, axis=0), np.repeat(high, self.n, axis=0)]
        self.seen_top, self.seen_bottom = np.zeros(x.shape, bool), np.zeros(x.shape, bool)

    def read(self, depth: int) -> None:
        """Go on to ``depth`` entries of each list."""
        old, self.depth = self.depth, min(depth, self.n)
        down, up = slice(self.n - self.depth, self.n - old), slice(old, self.depth)
        for part, bound, seen, reached in ((down, self.top, self.seen_top, self.n - self.depth), (up, self.bottom, self.seen_bottom, self.depth - 1)):
            at = (self.order[part], self.column)
            seen[at] = True
            for b in bound:
                b[at] = self.sorted[part]
            bound[0] = np.where(seen, bound[0], self.sorted[reached])

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of the scores of all candidates, (queries, candidates)."""
        pos, neg = np.maximum(q, 0), np.minimum(q, 0)
        upper, lower = (pos @ t.T + neg @ b.T for t, b in zip(self.top, self.bottom))
        return upper, lower


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of the pairs (i, j), in steps of bounded size."""
    out = np.empty(len(i), q.dtype)
    for lo in range(0, len(i), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        out[part] = (q[i[part]] * x[j[part]]).sum(axis=1)
    return out


def search_block(q: np.ndarray, x: np.ndarray, kth: np.ndarray, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score, depth): all pairs of a query and a candidate of the block that can
    be among the query's best k, given its k-th score ``kth`` so far (the least long where there is none),
    and the depth to which the lists were read for each query."""
    most = int(abs(q).max(initial=0)) * int(abs(x).max(initial=0)) * max(x.shape[1], 1)
    kind = np.float64 if most < 2**53 else object
    qn, xn = q.astype(kind), x.astype(kind)
    lists = Lists(xn)
    open_ = np.arange(len(q))
    found = []
    depth_of = np.zeros(len(q), np.int64)
    step = depth = max(-(-len(x) // s.rounds), 1)
    while len(open_):
        lists.read(depth)
        upper, lower = lists.bounds(qn[open_])
        least = kth[open_].astype(kind)
        if len(x) >= k:
            low = np.partition(lower, len(x) - k, axis=1) if kind is np.float64 else np.sort(lower, axis=1)
            least = np.maximum(least, low[:, len(x) - k])
        left = upper >= least[:, None]
        stop = (left.sum(axis=1) <= max(s.few * lists.n, k)) | (lists.depth == lists.n)
        i, j = np.nonzero(left[stop])
        done = open_[stop]
        score = upper[stop][i, j] if lists.depth == lists.n else _exact(qn, xn, done[i], j)
        if len(score) and kind is object and max(abs(v) for v in score) >= 2**63:
            raise OverflowError("a score is outside the range of a long")
        found.append((done[i], j, score.astype(np.int64)))
        depth_of[done] = lists.depth
        open_ = open_[~stop]
        depth += step
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), depth_of
    i, j, score = (np.concatenate(c) for c in zip(*found))
    return i, j, score, depth_of


_LEAST = np.iinfo(np.int64).min


class Cell:
    """One block of queries and one slice of candidates, taken in that order in parts."""

    def __init__(self, s: Settings):
        self.s, self.k = s, s.k + 1  # one more than asked: the query itself may be among them
        self.keys: list = []
        self.q: list = []
        self.waiting: list[pd.DataFrame] = []
        self.n_waiting = 0
        self.best: pd.DataFrame | None = None
        self.kth: np.ndarray | None = None

    def take(self, part: pd.DataFrame) -> None:
        if part["side"].iloc[0] == 0:
            self.keys += part["key"].to_list()
            self.q += part["x"].to_list()
            return
        if not self.keys:  # no query of this length
            return
        for lo in range(0, len(part), self.s.block):
            self.waiting.append(part.iloc[lo : lo + self.s.block])
            self.n_waiting += len(self.waiting[-1])
            if self.n_waiting >= self.s.block:
                self.flush()

    def flush(self) -> None:
        if not self.n_waiting:
            return
        c = pd.concat(self.waiting, ignore_index=True)
        self.waiting, self.n_waiting = [], 0
        if self.kth is None:
            self.q = np.array(self.q, np.int64).reshape(len(self.keys), -1)
            self.kth = np.full(len(self.keys), _LEAST)
        x = np.array(c["x"].to_list(), np.int64).reshape(len(c), -1)
        i, j, score, _ = search_block(self.q, x, self.kth, self.k, self.s)
        c = c.iloc[j]
        new = pd.DataFrame({"query": i, "score": score, "noid": c["noid"].to_numpy(), "vec_id": c["vec_id"].to_numpy(), "key": c["key"].to_numpy()})
        b = new if self.best is None else pd.concat([self.best, new], ignore_index=True)
        order = np.lexsort((b["vec_id"].to_numpy(), b["noid"].to_numpy(), ~b["score"].to_numpy(), b["query"].to_numpy()))
        b = b.iloc[order]
        q = b["query"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.kth[q[place == self.k - 1]] = b["score"].to_numpy()[place == self.k - 1]
        self.best = b[place < self.k]

    def finish(self) -> Iterator[pd.DataFrame]:
        self.flush()
        if self.best is not None and len(self.best):
            b = self.best
            own = [self.keys[i] for i in b["query"]]
            yield pd.DataFrame({"qkey": own, "score": b["score"].to_numpy(), "noid": b["noid"].to_numpy(), "vec_id": b["vec_id"].to_numpy(),
                                "same": [x == y for x, y in zip(own, b["key"])]})


def _cells(placed: DataFrame, s: Settings) -> DataFrame:
    """(qkey, score, noid, vec_id, same): the best k + 1 candidates of each query in each cell."""
    cell = ["dim", "qb", "slice"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, c = None, None
        for b in batches:
            place = b[[*cell, "side"]].to_numpy()
            edge = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *edge], [*edge, len(b)]):
                if lo == hi:
                    continue
                if now != tuple(place[lo][:3]):
                    if c is not None:
                        yield from c.finish()
                    now, c = tuple(place[lo][:3]), Cell(s)
                c.take(b.iloc[lo:hi])
        if c is not None:
            yield from c.finish()
        release()

    x = placed.repartition(parallelism(placed.sparkSession), *cell).sortWithinPartitions(*cell, "side", "key", "noid", "vec_id")
    return x.mapInPandas(run, "qkey binary, score long, noid boolean, vec_id long, same boolean")


def top_k(vectors: DataFrame, is_query: Column, s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` (vec_id, embedding) with the highest
    scores for each row where ``is_query`` (over vec_id) holds, other than the row itself; ties go to the
    smaller id. All are given where there are fewer than ``k``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding")))
    rows = rows.select("vec_id", scaled(F.col("embedding"), s.scale).alias("x"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.array_join("x", ","), 256)))
    rows = rows.withColumn("noid", F.col("vec_id").isNull())
    asked = rows.where(is_query & ~F.col("noid"))
    # Of equal vectors only the k + 1 smallest ids can be in an answer; Spark limits each part before the shuffle.
    w = W.partitionBy("key").orderBy("noid", "vec_id")
    cand = cut_lineage(rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= s.k + 1).drop("_n"))
    queries = cut_lineage(asked.groupBy("key").agg(F.first("x").alias("x")))
    n_blocks = max(-(-queries.count() // s.query_block), 1)
    n_slices = max(min(3 * parallelism(spark) // n_blocks, -(-cand.count() // s.block)), 1)
    common = [F.size("x").alias("dim"), "qb", "slice", "side", "key", "x", "vec_id", "noid"]
    left = queries.withColumns({"qb": F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int"), "slice": F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))),
                                "side": F.lit(0), "vec_id": F.lit(0).cast("long"), "noid": F.lit(False)})
    right = cand.withColumns({"slice": F.pmod(F.xxhash64("key", "vec_id"), F.lit(n_slices)).cast("int"), "qb": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))),
                              "side": F.lit(1), "vec_id": F.coalesce("vec_id", F.lit(0))})
    found = _cells(left.select(*common).union(right.select(*common)), s)
    w = W.partitionBy("qkey").orderBy(F.desc("score"), "noid", "vec_id", F.desc("same"))
    found = found.withColumn("at", F.row_number().over(w)).where(F.col("at") <= s.k + 1)
    entry = F.struct("at", "score", F.when(~F.col("noid"), F.col("vec_id")).alias("vec_id"), "same")
    lists = found.groupBy("qkey").agg(F.sort_array(F.collect_list(entry)).alias("list"))  # k + 1 entries at most
    # Many rows may ask with one vector, so its list is dealt out in 16 parts.
    lists = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    asked = asked.groupBy(F.col("vec_id").alias("query_id"), "key").agg(F.count("*").alias("copies"))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(16)).cast("int"))
    out = asked.join(lists, (asked.key == lists.qkey) & (asked.part == lists.part)).select("query_id", "copies", "list")
    out = out.withColumn("own", F.expr("array_position(transform(list, e -> e.same and e.vec_id <=> query_id), true)"))
    out = out.withColumn("list", F.slice(F.expr("filter(list, (e, i) -> i + 1 <> own)"), 1, s.k))
    out = out.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    out = out.select("query_id", F.posexplode("list").alias("pos", "e"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def oracle(s: Settings = Settings(), every: int = 50) -> str:
    """DuckDB SQL by scoring every pair of a query and another row."""
    return f"""
WITH vecs AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (
  SELECT r, vec_id, list_transform(e, lambda c: floor({s.scale} * c)) AS x FROM vecs
  WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
scores AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % {every} = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {s.k}"""
