"""Periodic runs of words (operator 13) by longest common extensions over a difference cover.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
equal) and a length of at least ``max(least, 3 * q)`` that no neighbouring word extends.

* Suffixes are sorted only where they start at a position of a difference cover: of any two
  positions, some shift below ``MODULUS`` puts both on the cover. Sorting refines groups of equal
  beginnings word by word up to ``MODULUS`` words, then by doubling, in whole-array steps.
* The common extension of two positions is found by comparing words up to that shift, then as the least
  common prefix between two ranks, from a sparse table.
* Runs are found on a harmonic grid: for each period ``p`` only positions a multiple of a step
  that grows with ``p`` are compared with the position ``p`` later, so a text of ``n`` words needs
  about ``n log n`` extensions. The start of a stretch is found by bisection over extensions.

Spark deals the rows out; each task searches the texts of one batch, grouped by similar
length, so memory follows the batch and the longest text. No step knows other rows.

Defined results: a null text has no words and no runs, and its collapsed text is empty; an empty table
gives an empty table; rows that repeat an id are searched on their own; further columns are not
read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

#: A perfect difference set: every number below MODULUS is a difference of two members, modulo MODULUS.
MODULUS = 31
COVER = np.array([1, 5, 11, 24, 25, 27])

#: Pairs of the grid compared in one step.
GRID_ROWS = 1 << 20

_AT = np.full(MODULUS, -1)  # place of a residue in the cover
_AT[COVER] = np.arange(len(COVER))
_TO = np.zeros((MODULUS, MODULUS), np.int64)  # [i mod, (j - i) mod] -> shift that puts both on the cover
for _d in range(MODULUS):
    _a = next(int(a) for a in COVER if _AT[(a + _d) % MODULUS] >= 0)
    _TO[:, _d] = (_a - np.arange(MODULUS)) % MODULUS


class Extensions:
    """Longest common extensions to the right of pairs of positions in ``words``: whole numbers from
    0, several texts one after the other, ``text[i]`` being the number (rising) of a position's text.
    Extensions end with the text."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.n = n = len(words)
        high = int(words.max(initial=0)) + 1
        # Each text ends before a word of its own, and so does all of it; the rest is room for shifts.
        self.w = np.concatenate((words.astype(np.int64), np.full(2 * MODULUS, high, np.int64)))
        self.end = np.concatenate((np.searchsorted(text, text, side="right"), np.full(2 * MODULUS, n)))
        at = np.arange(n)
        self.pos = at[_AT[at % MODULUS] >= 0]
        self.index = np.full(n + 2 * MODULUS, -1, np.int64)
        self.index[self.pos] = np.arange(len(self.pos))
        self.high = high
        self._sort(text)
        self._table()

    def _word(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Words at positions, one more than each word where the text has ended before."""
        return np.where(at < end, self.w[np.minimum(at, self.n)] + 1, 0)

    @staticmethod
    def _refine(rank: np.ndarray, some: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Split groups of equal rank (members ``some``) by ``key``; ``rank`` (the number of members of
        smaller groups) is changed in place. Returns the members of groups that stay larger than one."""
        order = np.lexsort((key, rank[some]))
        member, r, k = some[order], rank[some][order], key[order]
        new_r = np.concatenate(([True], r[1:] != r[:-1]))
        new = new_r | np.concatenate(([True], k[1:] != k[:-1]))
        at = np.arange(len(r))
        first, sub = np.maximum.accumulate(np.where(new_r, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        rank[member] = r + sub - first
        alone = new & np.concatenate((new[1:], [True]))
        return member[~alone]

    def _sort(self, text: np.ndarray) -> None:
        m = len(self.pos)
        rank = np.zeros(m, np.int64)
        open_ = np.arange(m)
        end = self.end[self.pos]
        if m:
            open_ = self._refine(rank, open_, text[self.pos].astype(np.int64))
        for d in range(MODULUS):
            if not len(open_):
                break
            open_ = self._refine(rank, open_, self._word(self.pos[open_] + d, end[open_]))
        # Beyond MODULUS words: equal beginnings of a length, then of twice that length. Each level is
        # kept, since two neighbours differ at the first level that tells them apart.
        self.levels, width = [], MODULUS
        while len(open_):
            self.levels.append((width, rank.copy()))
            after = self.pos[open_] + width
            inside = after < end[open_]
            nxt = np.where(inside, self.index[np.minimum(after, self.n)], 0)
            open_ = self._refine(rank, open_, np.where(inside, rank[nxt] + 1, 0))
            width *= 2
        self.rank = rank
        self.order = np.empty(m, np.int64)
        self.order[rank] = np.arange(m)

    def _compare(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, up to ``limit``, compared one by one."""
        out = np.zeros(len(i), np.int64)
        left = np.arange(len(i))
        t = 0
        while len(left):
            left = left[limit[left] > t]
            a, b = i[left] + t, j[left] + t
            left = left[(a < self.end[i[left]]) & (b < self.end[j[left]]) & (self.w[np.minimum(a, self.n)] == self.w[np.minimum(b, self.n)])]
            out[left] += 1
            t += 1
        return out

    def _table(self) -> None:
        m = len(self.order)
        lcp = np.zeros(max(m, 1), np.int64)
        if m > 1:
            a, b = self.pos[self.order[:-1]], self.pos[self.order[1:]]
            same = np.flatnonzero(self.end[a] == self.end[b])
            a, b = a[same].copy(), b[same].copy()
            far = np.zeros(len(same), np.int64)
            end = self.end[a]
            for width, rank in reversed(self.levels):
                eq = np.maximum(a, b) < end
                eq[eq] = rank[self.index[a[eq]]] == rank[self.index[b[eq]]]
                far[eq] += width
                a[eq] += width
                b[eq] += width
            inside = np.maximum(a, b) < end
            far[inside] += self._compare(a[inside], b[inside], np.full(int(inside.sum()), MODULUS))
            lcp[same + 1] = far
        self.least = [lcp.astype(np.int32)]
        while 2 << (len(self.least) - 1) <= len(lcp):
            row, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(row[:-half], row[half:]))

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For positions of one text each, i < j: the number of equal words from i and j on."""
        shift = _TO[i % MODULUS, (j - i) % MODULUS]
        out = self._compare(i, j, shift)
        more = np.flatnonzero((out == shift) & (j + shift < self.end[j]))
        if len(more):
            a, b = self.rank[self.index[(i + shift)[more]]], self.rank[self.index[(j + shift)[more]]]
            lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            best = np.empty(len(more), np.int64)
            for k in np.unique(level):
                at = level == k
                row = self.least[k]
                best[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
            out[more] += best
        return out


def _grid(period: np.ndarray, step: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, p, g): multiples i of the step g of each period p, with i + p < n, in bounded chunks."""
    count = np.maximum((n - period + step - 1) // step, 0)
    chunk = (np.cumsum(count) - 1) // GRID_ROWS
    for c in np.unique(chunk):
        of = np.flatnonzero(chunk == c)
        first = np.cumsum(count[of]) - count[of]
        total = int(count[of].sum())
        for lo in range(0, total, GRID_ROWS):  # a period of a long text has more than one chunk alone
            row = np.arange(lo, min(lo + GRID_ROWS, total))
            which = np.searchsorted(first, row, side="right") - 1
            yield (row - first[which]) * step[of][which], period[of][which], step[of][which]


def search(words: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the texts laid one after the other, by start, then period."""
    none = np.empty(0, np.int64)
    n = len(words)
    size = np.bincount(text) if n else none
    if not n or int(size.max()) < max(least, 3):
        return none, none, none
    ext = Extensions(words, text)
    period = np.arange(1, int(size.max()) // 3 + 1)
    equal = np.maximum(least, 3 * period) - period  # equal words at distance p that a run has at least
    step = np.maximum(equal // 2, 1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, p, g in _grid(period, step, n):
        hit = (words[i] == words[i + p]) & (text[i] == text[i + p])
        i, p, g = i[hit], p[hit], g[hit]
        if not len(i):
            continue
        # The first multiple of the step in a long enough stretch has at least this much of it to its right.
        need = np.maximum(least, 3 * p) - p - g + 1
        right = ext.lce(i, i + p)
        far = right >= need
        i, p, g, right = i[far], p[far], g[far], right[far]
        # A stretch that reaches the multiple before is met from there; of the others, bisection finds
        # how many words to the left belong to it.
        room = i - np.searchsorted(text, text[i])
        later = room >= g
        later[later] = ext.lce((i - g)[later], (i - g + p)[later]) >= g[later]
        i, p, right, low, high = i[~later], p[~later], right[~later], np.zeros(int((~later).sum()), np.int64), np.minimum(g - 1, room)[~later]
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = ext.lce(i - mid, i - mid + p) >= mid
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        start, stop = i - low, i + right + p
        long_ = stop - start >= np.maximum(least, 3 * p)
        found.append((start[long_], stop[long_], p[long_]))
    if not found:
        return none, none, none
    start, stop, p = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((p, stop, start))
    start, stop, p = start[order], stop[order], p[order]
    # A stretch with several periods has them all as multiples of its smallest (it is three times as long).
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, p = start[new], stop[new], p[new]
    order = np.lexsort((p, start))
    return start[order], stop[order], p[order]


#: Changes the words of a document; gets its id in decimal (None where there is none).
Edit = Callable[[str | None, list[bytes]], list[bytes]]


def _documents(ids: list, texts: list, least: int, edit: Edit | None) -> list[tuple]:
    """(n_words, starts, lengths, periods, collapsed) of each text of a batch."""
    split = []
    for d, t in zip(ids, texts):
        w = t.split() if t is not None else []  # bytes split at 0x20 and 0x09-0x0D
        split.append(edit(d, w) if edit is not None else w)
    out: list = [None] * len(split)
    size = np.array([len(w) for w in split], np.int64)
    group = np.frexp(size.astype(np.float64))[1]  # lengths within a factor of two are searched together
    empty = np.empty(0, np.int64)
    for k in np.unique(group):
        of = np.flatnonzero(group == k)
        if size[of].max() < least:
            for d in of:
                out[d] = (int(size[d]), empty, empty, empty, b" ".join(split[d]))
            continue
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        words = np.fromiter((n for d in of for n in map(number.__getitem__, split[d])), np.int64, int(size[of].sum()))
        text = np.repeat(np.arange(len(of)), size[of])
        start, stop, p = search(words, text, least)
        base = np.cumsum(size[of]) - size[of]
        whose = text[start]
        bound = np.searchsorted(whose, np.arange(len(of) + 1))
        for x, d in enumerate(of):
            s = slice(bound[x], bound[x + 1])
            if s.start == s.stop:
                out[d] = (int(size[d]), empty, empty, empty, b" ".join(split[d]))
                continue
            own, stop_, q = start[s] - base[x], stop[s] - base[x], p[s]
            cut = np.zeros(size[d] + 1, np.int64)
            np.add.at(cut, own + q, 1)
            np.add.at(cut, stop_, -1)
            keep = np.cumsum(cut)[:-1] == 0
            w = split[d]
            out[d] = (int(size[d]), own, stop_ - own, q, b" ".join([w[y] for y in np.flatnonzero(keep)]))
    return out


def find_runs(docs: DataFrame, least: int = 24, edit: Edit | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row of ``docs`` (doc_id, text): all runs as an array of
    (start, length, period) by start, then period, and the text's words without those that a run
    repeats (the words of a run after its first period), joined by one space.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. ``edit`` may change the words of a document
    before the search; it is called once per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = _documents(b["doc_id"].to_list(), b["text"].to_list(), least, edit)
            n, s, length, p, kept = zip(*rows) if rows else ((),) * 5
            yield pd.DataFrame({"doc_id": b["doc_id"].to_list(), "n_words": list(n), "starts": list(s), "lengths": list(length),
                                "periods": list(p), "collapsed": list(kept)})
        release()

    x = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    x = x.mapInPandas(run, "doc_id string, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed binary")
    zipped = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    return x.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", zipped.alias("runs"), F.col("collapsed").cast("string").alias("collapsed"))


def planted_tail(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """The query's edit: with ``h`` the checksum of the decimal id and ``g = h // 10``, a document of
    ``h % 10 == 0`` repeats, from word ``a = g % n`` on, its ``1 + (n - a) // (3 + g % 8)`` words from there. A row
    without an id stays as it is."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(doc_id.encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digests(found: DataFrame) -> DataFrame:
    """One row per document of ``find_runs``: number of runs, the run with the greatest exact
    ``length / period`` (ties: smallest start, then period; no run: nulls), and SHA-256 of all
    runs (lines ``start,length,period``) and of the collapsed text."""
    r = F.col("runs")
    line = F.transform(r, lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    # Runs come by start, then period, so only a greater ratio replaces the best one.
    best = F.aggregate(F.slice(r, 2, F.size(r)), F.try_element_at(r, F.lit(1)),
                       lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    out = found.select("doc_id", F.size(r).cast("long").alias("n_runs"), best.alias("best"),
                       F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))
    b = F.col("best")
    return out.select("doc_id", "n_runs", b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"),
                      F.expr("1000L * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
