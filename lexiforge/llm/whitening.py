"""Embedding whitening by a polarisation covariance (operator 12).

Vectors become whole numbers, ``x = floor(scale * component) + offset``, and all sums are exact. The covariance
is not summed from products: one aggregate adds the squares of the centred values of every dimension and of
every sum of two dimensions, and cross-covariances are differences of these variances,
``2 cov(i, j) = var(i + j) - var(i) - var(j)``. The matrix is assembled from whole numbers and handed to ``eigh``.

* The fit list is each distinct vector once. Centring takes the whole part ``m`` of the mean out of each
  value first, so squares stay small. With ``n`` rows, ``S`` their sum and ``r = S - n m``,
  ``sum (n x - S)^2 = n^2 sum (x - m)^2 - n r^2``, which is settled in whole numbers of any size.
* A task adds up its batches and returns one row with a number per dimension and pair of dimensions; a fixed number
  of tasks add up these rows, so the driver gets that many rows whatever the size of the table.
* Eigenvectors of ``eigh`` are refined by Jacobi rotations in extended precision, so that small
  eigenvalues beside large ones keep their relative precision.

Defined results: vectors that are null or hold null or non-finite entries are dropped, and so are vectors of another
length than the most frequent one of the fit list (of equally frequent ones the longest); rows that repeat an id or have none stay,
each with its own result; components without variance (equal rows, dimensions that depend on each other; in
figures, a share of the trace under the rounding of extended precision, about 1e-18 times the dimensions) are
left out, since nothing divides them to one, so a table of one distinct vector gives no rows; components whose
scaled value is outside a long are an error; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, release


@dataclass(frozen=True)
class Settings:
    scale: int = 64
    offset: int = 1_000_000
    components: int = 16


@dataclass(frozen=True)
class Whitening:
    """A fitted model. ``whole + rest / n`` is the mean, ``axes`` the unit eigenvectors (columns) of the
    covariance by falling eigenvalue, ``trace`` the sum of all its eigenvalues."""

    n: int
    dim: int
    whole: tuple[int, ...]
    rest: tuple[int, ...]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None


def usable(e: Column) -> Column:
    """Whether a vector is not null and holds finite numbers only."""
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(e.isNotNull() & ~bad, F.lit(False))


def whole_numbers(vectors: DataFrame, s: Settings) -> DataFrame:
    """(vec_id, x) of the usable rows."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(s.scale)) * c.cast("double")) + F.lit(s.offset).cast("long"))
    return vectors.select("vec_id", "embedding").where(usable(F.col("embedding"))).select("vec_id", x.alias("x"))


#: Tasks that add up the sums of all tasks before the driver gets one row of each.
MERGES = 16


def _totals(x: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str = "decimal(38, 0)") -> list:
    """Sums over all rows of what ``part`` returns for a matrix of rows: exact whole numbers, or doubles. A
    task gives one row of sums, a few tasks add these up, and the driver gets their rows."""
    exact = kind != "double"

    def pack(total) -> pd.DataFrame:
        return pd.DataFrame({"t": [[Decimal(int(v)) for v in total] if exact else list(total)]})

    def add(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if not len(b):
                continue
            if column == "x":
                t = part(np.array(b["x"].to_list(), np.int64))
                t = t.astype(object) if exact else t
            else:
                t = sum(np.array([int(v) for v in r], object) if exact else np.asarray(r) for r in b["t"])
            total = t if total is None else total + t
        if total is not None:
            yield pack(total)
        release()

    schema = f"t array<{kind}>"
    sums = x.mapInPandas(lambda batches: add(batches, "x"), schema)
    rows = sums.repartition(MERGES).mapInPandas(lambda batches: add(batches, "t"), schema).collect()
    return [sum(int(v) if exact else v for v in c) for c in zip(*(r["t"] for r in rows))]


def _centred(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``x - whole``, in Python's integers where a long could overflow."""
    near = max(int(abs(x).max(initial=0)), int(abs(whole).max(initial=0))) < 2**61
    return x - whole if near else x.astype(object) - whole.astype(object)


def polarised_squares(z: np.ndarray) -> np.ndarray:
    """Sums over the rows of the squares of each column, then of each sum of two columns (in the order of
    ``np.triu_indices(d, 1)``)."""
    if z.dtype != object and (2 * int(abs(z).max(initial=0))) ** 2 * max(len(z), 1) >= 2**63:
        z = z.astype(object)
    out = [(z * z).sum(axis=0)]
    for i in range(z.shape[1] - 1):
        pair = z[:, i, None] + z[:, i + 1 :]
        out.append((pair * pair).sum(axis=0))
    return np.concatenate(out)


def covariance(squares: list[int], n: int, rest: tuple[int, ...]) -> list[list[Fraction]]:
    """The exact covariance (divisor n) from ``polarised_squares`` of values without the whole part of
    their means; ``rest`` is the sum of those values."""
    d = len(rest)
    single = [n * n * q - n * r * r for q, r in zip(squares, rest)]
    v = [[Fraction(0)] * d for _ in range(d)]
    for i in range(d):
        v[i][i] = Fraction(single[i], n**3)
    for (i, j), q in zip(zip(*np.triu_indices(d, 1)), squares[d:]):
        both = n * n * q - n * (rest[i] + rest[j]) ** 2
        v[i][j] = v[j][i] = Fraction(both - single[i] - single[j], 2 * n**3)
    return v


def eigen(v: list[list[Fraction]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors as columns, trace) by falling eigenvalue, without those of no variance."""
    d = len(v)
    trace = sum(v[i][i] for i in range(d))
    if not trace:
        return np.empty(0), np.empty((d, 0)), 0.0
    scaled = [[c / trace for c in row] for row in v]
    high = np.array([[float(c) for c in row] for row in scaled])
    low = np.array([[float(c - Fraction(float(c))) for c in row] for row in scaled])
    exact = high.astype(np.longdouble) + low.astype(np.longdouble)
    q = np.linalg.eigh(high)[1].astype(np.longdouble)
    q, t = _rotate(q, q.T @ exact @ q)
    q /= np.sqrt((q * q).sum(axis=0))
    e = ((exact @ q) * q).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    order = order[e[order] > d * 8 * np.finfo(np.longdouble).eps]
    q, e = q[:, order], e[order]
    q *= np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1, 1)
    return np.array([float(x) * float(trace) for x in e]), q.astype(np.float64), float(trace)


def _rotate(q: np.ndarray, t: np.ndarray, sweeps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Jacobi rotations until no entry of ``t = q' v q`` beside the diagonal counts against its two
    diagonal entries. After ``eigh`` few are left."""
    eps = np.finfo(np.longdouble).eps
    floor = eps * np.abs(np.diag(t)).max()
    for _ in range(sweeps):
        again = False
        for a in range(len(t) - 1):
            for b in range(a + 1, len(t)):
                if abs(t[a, b]) <= 4 * eps * np.sqrt(max(abs(t[a, a]), floor) * max(abs(t[b, b]), floor)):
                    continue
                again = True
                theta = (t[b, b] - t[a, a]) / (2 * t[a, b])
                tan = np.sign(theta) / (abs(theta) + np.sqrt(theta * theta + 1)) if theta else np.longdouble(1)
                cos = 1 / np.sqrt(tan * tan + 1)
                turn = np.array([[cos, tan * cos], [-tan * cos, cos]])
                t[:, [a, b]] = t[:, [a, b]] @ turn
                t[[a, b], :] = turn.T @ t[[a, b], :]
                q[:, [a, b]] = q[:, [a, b]] @ turn
        if not again:
            break
    return q, t


def project(x: np.ndarray, m: Whitening) -> np.ndarray:
    """Whitened rows, (rows, components). Sums run dimension by dimension, so a row's result does not
    depend on the rows that it is computed with."""
    y = _centred(x, np.array(m.whole, np.int64)).astype(np.float64) - np.array(m.rest, np.float64) / m.n
    out = np.zeros((len(x), m.axes.shape[1]))
    for d in range(m.dim):
        out += y[:, d, None] * m.axes[d]
    return out / np.sqrt(m.eigenvalues)


def fit(vectors: DataFrame, s: Settings = Settings()) -> Whitening | None:
    """The model of the distinct vectors of ``vectors`` (vec_id, embedding); none where there is no usable vector."""
    x = cut_lineage(whole_numbers(vectors, s).select("x").distinct())
    sizes = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes or not sizes[0]["d"]:
        return None
    dim, n = sizes[0]["d"], sizes[0]["n"]
    x = x.where(F.size("x") == dim)
    sums = _totals(x, lambda a: a.astype(object).sum(axis=0) if int(abs(a).max()) >= 2**63 // len(a) else a.sum(axis=0))
    whole, rest = tuple(t // n for t in sums), tuple(t % n for t in sums)
    centre = np.array(whole, np.int64)
    squares = _totals(x, lambda a: polarised_squares(_centred(a, centre)))
    values, axes, trace = eigen(covariance(squares, n, rest))
    m = Whitening(n, dim, whole, rest, axes[:, : s.components], values[: s.components], trace)
    return Whitening(**{**m.__dict__, "identity_error": _identity_error(x, m)})


def _identity_error(x: DataFrame, m: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, summed over
    the rows as they come out. Whitened values are centred already; what is left of their mean is taken off."""
    k = m.axes.shape[1]
    if not k:
        return None
    upper = np.triu_indices(k)

    def part(rows: np.ndarray) -> np.ndarray:
        w = project(rows, m)
        return np.concatenate((w.sum(axis=0), (w.T @ w)[upper]))

    t = np.array(_totals(x, part, "double")) / m.n
    mean, second = t[:k], t[k:]
    return float(np.abs(second - mean[upper[0]] * mean[upper[1]] - (upper[0] == upper[1])).max())


def whiten(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) per usable row of ``vectors``: the exact sum over
    dimensions of ``(n x - S)^2`` as decimal(38, 0), and arrays of the whitened value and of the explained share
    by component."""
    schema = "vec_id long, n long, deviation decimal(38, 0), whitened array<double>, explained array<double>, identity_error double"
    m = fit(vectors, s)
    if m is None or not len(m.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, rest = np.array(m.whole, np.int64), np.array(m.rest, object)
        for b in batches:
            if not len(b):
                continue
            x = np.array(b["x"].to_list(), np.int64)
            z = _centred(x, whole)
            small = z.dtype != object and (m.n * (int(abs(z).max()) + 1)) ** 2 * m.dim < 2**63
            y = m.n * z - rest.astype(np.int64) if small else m.n * z.astype(object) - rest
            yield pd.DataFrame({"vec_id": b["vec_id"].to_list(), "deviation": [Decimal(int(v)) for v in (y * y).sum(axis=1)], "whitened": list(project(x, m))})
        release()

    rows = whole_numbers(vectors, s).where(F.size("x") == m.dim).select(F.col("vec_id").cast("string").alias("vec_id"), "x")
    out = rows.mapInPandas(run, "vec_id string, deviation decimal(38, 0), whitened array<double>")
    shares = F.array(*[F.lit(float(e / m.trace)) for e in m.eigenvalues])
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened",
                      shares.alias("explained"), F.lit(m.identity_error).alias("identity_error"))


def by_component(whitened: DataFrame) -> DataFrame:
    """One row per row and component of ``whiten``: (vec_id, component from 1, n, deviation as a long, null where
    outside of one, whitened, explained, identity_error)."""
    x = whitened.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return x.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")
