"""Whitening of embeddings along their leading principal components.

Entries become integers, x = floor(scale * c). The fit list is each distinct x vector once. Its sums are exact;
its covariance is added up task by task from vectors centred at the mean (one matrix for each task, added up by matrix row).
The driver holds nothing but that square matrix: Householder reflections make it tridiagonal, Sturm counts
bisect for its leading eigenvalues, inverse iteration finds their vectors, and vectors of a cluster of close
eigenvalues are made orthogonal to each other again. The components then go to all tasks, which project every row.

Rows whose vector is null or holds null or non-finite entries are dropped. Zero and repeated vectors stay. Vectors of
different lengths are spaces of their own, each with its own fit; an empty vector has no components, so no rows.
A component whose variance is zero to working precision can't be scaled: its `whitened` is null, and it is left out of `identity_error`.
`deviation` is null where it doesn't fit a long. Entries beyond the longs' range saturate. An empty table gives no rows.
Null and repeated ids are kept as they are. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

SCALE = 256
#: Eigenvalues closer than this share of the matrix norm form a cluster.
CLUSTER = 1e-3
#: An eigenvalue under this share of the largest is zero to working precision, for each dimension.
ZERO = 4 * np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, Q) with Q' a Q tridiagonal, for a symmetric matrix; one reflection clears each column."""
    a, n = a.astype(float).copy(), len(a)
    q = np.eye(n)
    for j in range(n - 2):
        v = a[j + 1 :, j].copy()
        size = np.abs(v).max()
        if size == 0 or not v[1:].any():
            continue
        v /= size
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v *= np.sqrt(2 / (v @ v))
        a[j + 1 :, :] -= np.outer(v, v @ a[j + 1 :, :])
        a[:, j + 1 :] -= np.outer(a[:, j + 1 :] @ v, v)
        q[:, j + 1 :] -= np.outer(q[:, j + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def count_below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm's count: how many eigenvalues of the tridiagonal matrix lie below each x, from the signs of the pivots."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float((e**2).max()) if len(e) else 1.0)
    pivot, below = np.ones_like(x), np.zeros(x.shape, int)
    for i in range(len(d)):
        pivot = d[i] - x - (e[i - 1] ** 2 / pivot if i else 0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, all bisected at once until the intervals can't shrink."""
    n = len(d)
    reach = np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    pad = 2 * np.finfo(float).eps * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high, place = low - pad, high + pad, n - 1 - np.arange(k)
    while True:
        mid = low + (high - low) / 2
        if not ((mid > low) & (mid < high)).any():
            return mid
        left = count_below(d, e, mid) > place
        low, high = np.where(left, low, mid), np.where(left, mid, high)


def solve_tridiagonal(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift)^-1 b by elimination with row exchanges; a zero pivot is replaced by a tiny one."""
    n = len(d)
    scale = max(float(np.abs(d).max()), float(np.abs(e).max()) if len(e) else 0.0, np.finfo(float).tiny)
    tiny = np.finfo(float).eps * scale
    rows, x = np.zeros((n, 3)), b.astype(float).copy()
    here = np.array([d[0] - shift, e[0] if n > 1 else 0.0, 0.0])
    for i in range(n - 1):
        below = np.array([e[i], d[i + 1] - shift, e[i + 1] if i + 2 < n else 0.0])
        if abs(below[0]) > abs(here[0]):
            here, below = below, here
            x[i], x[i + 1] = x[i + 1], x[i]
        if here[0] == 0:
            here[0] = tiny
        f = below[0] / here[0]
        rows[i] = here
        x[i + 1] -= f * x[i]
        here = np.array([below[1] - f * here[1], below[2] - f * here[2], 0.0])
    rows[n - 1] = here if abs(here[0]) > tiny else [tiny, 0, 0]
    for i in range(n - 1, -1, -1):
        rest = sum(rows[i, j] * x[i + j] for j in (1, 2) if i + j < n)
        x[i] = (x[i] - rest) / rows[i, 0]
        if (most := np.abs(x).max()) > 1e150:
            x /= most
    return x


def leading_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows."""
    a = np.asarray(a, float)
    size = np.abs(a).max() if a.size else 0.0
    k = min(k, len(a))
    if size == 0:
        return np.zeros(k), np.eye(len(a))[:k]
    d, e, q = tridiagonal(a / size)
    values = leading_values(d, e, k)
    norm = np.abs(values).max()
    draw, found, first = np.random.default_rng(0), np.zeros((k, len(d))), 0
    for i in range(k):
        if i and values[i - 1] - values[i] > CLUSTER * norm:
            first = i
        x = draw.standard_normal(len(d))
        shift = values[i] - (i - first) * np.finfo(float).eps * norm  # equal values get shifts that differ
        for _ in range(6):
            x = solve_tridiagonal(d, e, shift, x / np.linalg.norm(x))
            x /= np.linalg.norm(x)
            for _ in range(2):  # orthogonal to the cluster's vectors; twice is enough
                x -= found[first:i].T @ (found[first:i] @ x)
                x /= np.linalg.norm(x)
        found[i] = x
    vectors = found @ q.T
    return values * size, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(vectors: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> list:
    """The sums over all tasks of what each has summed: of(x) gives an array for a batch. The driver gets one value for each of its places."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                y = of(_matrix(b.column(0))).ravel()
                total = y if total is None else total + y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.tolist(), pa.float64() if kind == "double" else pa.decimal128(38, 0))], ["place", "value"])

    rows = mapped(vectors.select("x"), step, f"place long, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).collect()
    return [r["value"] for r in sorted(rows)]


def _exact(x: np.ndarray) -> np.ndarray:
    """Column sums in Python's integers, from sums of the upper and lower halves."""
    return ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)


def covariance(vectors: DataFrame, of: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Sum of of(x) of(x)' over the rows, over n; of() centres."""

    def products(x: np.ndarray) -> np.ndarray:
        y = of(x)
        return y.T @ y

    sums = np.array(_added(vectors, products))
    side = int(round(len(sums) ** 0.5))
    return sums.reshape(side, side) / n


@dataclass
class Fit:
    """The fit list's size, exact sums and leading components; `error` is that of the whitened fit list's covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    error: float | None = None

    @property
    def usable(self) -> np.ndarray:
        return self.values > ZERO * self.vectors.shape[1] * max(self.values[0], 0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column for each component; not a number where it can't be scaled."""
        scale = np.where(self.usable, self.values, np.nan)
        return (x - np.array([s / self.n for s in self.sums])) @ self.vectors.T / np.sqrt(scale)


def fit(vectors: DataFrame, k: int = 4) -> Fit:
    """From the distinct vectors `x` (array<long>, all of one length)."""
    n, sums = vectors.count(), [int(s) for s in _added(vectors, _exact, "decimal(38,0)")]
    mean = np.array([s / n for s in sums])
    v = covariance(vectors, lambda x: x - mean, n)
    values, components = leading_components((v + v.T) / 2, k)
    trace = np.trace(v)
    out = Fit(n, sums, values, components, values / trace if trace > 0 else np.zeros(len(values)))
    if out.usable.any():
        white = lambda x: out.whitened(x)[:, out.usable]
        centre = np.array(_added(vectors, lambda x: white(x).sum(0))) / n
        out.error = float(np.abs(covariance(vectors, lambda x: white(x) - centre, n) - np.eye(len(centre))).max())
    return out


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _project(fitted: Fit) -> Callable:
    k = len(fitted.values)

    def deviations(x: np.ndarray) -> pa.Array:
        """Exact: in longs where no step can leave their range, else in Python's integers."""
        most = max(map(abs, fitted.sums), default=0) + fitted.n * max(abs(int(x.min())), abs(int(x.max())))
        if most * most * x.shape[1] < 1 << 63:
            return pa.array(((fitted.n * x - np.array(fitted.sums, np.int64)) ** 2).sum(1), pa.int64())
        exact = [sum((fitted.n * c - s) ** 2 for c, s in zip(row, fitted.sums, strict=True)) for row in x.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column(1))
            white = fitted.whitened(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(len(b)), k))), pa.array(np.tile(np.arange(1, k + 1), len(b)), pa.int32()), pa.array(np.full(len(b) * k, fitted.n)),
                 deviations(x).take(pa.array(np.repeat(np.arange(len(b)), k))), pa.array(white, mask=~np.tile(fitted.usable, len(b))), pa.array(np.tile(fitted.explained, len(b))), pa.array([fitted.error] * (len(b) * k), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return step


def whitened(vectors: DataFrame, k: int = 4, scale: int = SCALE) -> DataFrame:
    """Each usable row of `vectors` (vec_id, embedding) along the leading k components, as OUT."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.coalesce(v.isNotNull() & finite & (F.size(v) > 0), F.lit(False))).select(F.col("vec_id").cast("long"), F.transform(v, lambda c: F.floor(scale * c)).alias("x"))
    distinct = written(rows.select("x").distinct(), "whiten-distinct")
    found = None
    for (dims,) in sorted(tuple(r) for r in distinct.select(F.size("x")).distinct().collect()):
        of = F.size("x") == dims
        part = mapped(rows.filter(of), _project(fit(distinct.filter(of), k)), OUT)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else vectors.sparkSession.createDataFrame([], OUT)
