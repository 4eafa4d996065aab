"""PCA whitening of vectors by Chebyshev-filtered subspace iteration.

Every component c becomes the long ``floor(64 c) + 1000000``; each distinct integer vector counts once in the
fit.  Their number, sums and covariance products come from distributed passes: a pass sends the current block Q
of d x k doubles to the tasks, each adds up XᵀXQ of its centred rows, and only d x k sums return.

* A short Lanczos run places the ends of the spectrum, so that the polynomial damps the unwanted part between its
  lower end and the first Ritz value that is not wanted.
* Each round applies the Chebyshev recurrence (one pass a degree), orthonormalises by QR and rotates by
  Rayleigh-Ritz; it ends when the residuals of the wanted pairs are at rounding level.
* The result is certified: a fresh random block, orthogonal to the one found and filtered in the same way, must hold no
  Ritz value above the least wanted one; otherwise the block grows by it and the rounds go on.

The number of passes depends on the spectrum, not on the rows; a pass reads the fit list, a settled table, from shared
storage, so a lost executor repeats its part of one pass.

Defined cases: vectors that are null, empty, or hold null or non-finite components are dropped, and so are those whose
length is not the commonest one (of equally common lengths the greater counts); repeated vectors and
null ids keep their rows; components without variance are not returned (one distinct vector, or none, gives
no rows); with fewer than 16 dimensions there are as many components; a component beyond 2**52 or a deviation that does
not fit a long is an error; only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.registry import query, table
from strideframe.llm.scratch import run_folder, settled

COMPONENTS, EXTRA, DEGREE, LANCZOS, ROUNDS = 16, 16, 10, 10, 60
FLOOR, CERTIFIED = 2e-14, 1e-10
SCALE, SHIFT = 64, 1_000_000
Batches = Iterator[pa.RecordBatch]


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _grid(batches: Batches) -> Batches:
    """vec_id and integer components of the usable vectors."""
    for batch in batches:
        keep, out = [], []
        for i, v in enumerate(batch.column("v")):
            if v.is_valid and len(v.values) and v.values.null_count == 0:
                x = v.values.to_numpy(zero_copy_only=False).astype(float)
                if np.isfinite(x).all():
                    if np.abs(x).max() * SCALE >= 2.0**52:
                        raise ValueError("a component is out of range")
                    keep.append(i)
                    out.append(np.floor(SCALE * x).astype(np.int64) + SHIFT)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep, pa.int64())), pa.array(out, pa.list_(pa.int64()))], ["vec_id", "x"])


class Fit:
    """The fit list: a table of distinct integer vectors ``x``, their number n and their sums."""

    def __init__(self, vectors: DataFrame, d: int):
        self.vectors, self.d, self.n = vectors, d, 0
        self.sums = np.zeros(d, np.int64)
        at = vectors.mapInArrow(self._totals, "at int, s long").groupBy("at").agg(F.sum("s").alias("s"))
        for r in at.collect():  # d + 1 rows
            if r["at"] == d:
                self.n = r["s"]
            else:
                self.sums[r["at"]] = r["s"]

    @staticmethod
    def _totals(batches: Batches) -> Batches:
        total = None
        for batch in batches:
            x = _matrix(batch.column("x"))
            if len(x):
                part = np.append(x.sum(0), len(x))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "s"])

    def passed(self, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of ``part`` over all centred vectors, added up in tasks and then by position."""
        n, sums = self.n, self.sums

        def run(batches: Batches) -> Batches:
            total = None
            for batch in batches:
                x = _matrix(batch.column("x"))
                if len(x):
                    here = part((n * x - sums) / n).ravel()
                    total = here if total is None else total + here
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "s"])

        out = np.zeros(size)
        for r in self.vectors.mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():  # one row an entry of the block
            out[r["at"]] = r["s"]
        return out

    def product(self, q: np.ndarray) -> np.ndarray:
        """V q for the covariance V, in one pass."""
        return self.passed(lambda x: x.T @ (x @ q), q.size).reshape(q.shape) / self.n


def _lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, rng: np.random.Generator) -> tuple[float, float]:
    """Estimates of the least and greatest eigenvalue."""
    q = rng.standard_normal(d)
    basis = [q / np.linalg.norm(q)]
    alpha, beta = [], []
    for _ in range(min(LANCZOS, d)):
        w = product(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        b = np.array(basis).T
        w = w - b @ (b.T @ w)
        w = w - b @ (b.T @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(1e-300, abs(alpha[0])):
            break
        basis.append(w / beta[-1])
    t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    values = np.linalg.eigvalsh(t)
    return max(0.0, float(values[0])), float(values[-1]) + beta[len(alpha) - 1]


def chebyshev(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, high: float, top: float, degree: int = DEGREE) -> np.ndarray:
    """p(V) q for the Chebyshev polynomial of [low, high], scaled to stay near 1 at ``top``: the three-term recurrence, one pass a degree."""
    half, centre = (high - low) / 2, (high + low) / 2
    sigma = first = half / (top - centre)
    before, here = q, (product(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, here = here, 2 * (following / half) * (product(here) - centre * here) - sigma * following * before
        sigma = following
    return here


def _ritz(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors and residual norms of the space of ``q``."""
    q = np.linalg.qr(np.linalg.qr(q)[0])[0]
    w = product(q)
    h = q.T @ w
    values, u = np.linalg.eigh((h + h.T) / 2)
    values, u = values[::-1], u[:, ::-1]
    vectors = q @ u
    return values, vectors, np.linalg.norm(w @ u - vectors * values, axis=0)


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, k: int = COMPONENTS, extra: int = EXTRA) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues (falling) and unit eigenvectors of a symmetric non-negative operator known by its products with blocks."""
    rng, k = np.random.default_rng(12), min(k, d)
    low, top = _lanczos(product, d, rng)
    if top <= 0:
        return np.zeros(0), np.zeros((d, 0))
    values, vectors, gaps = _ritz(product, rng.standard_normal((d, min(d, k + extra))))
    best, stuck, checked = math.inf, 0, False
    for _ in range(ROUNDS):
        worst = float(gaps[:k].max()) / values[0]
        stuck = 0 if worst < best / 2 else stuck + 1
        best = min(best, worst)
        high = float(values[-1])
        whole = vectors.shape[1] == d
        if whole or worst <= FLOOR or (stuck > 2 and worst <= CERTIFIED):
            if whole or checked:
                return values[:k], vectors[:, :k]
            # anything large that the start missed shows in a fresh block outside the space found
            fresh = rng.standard_normal((d, min(4, d - vectors.shape[1])))
            fresh -= vectors @ (vectors.T @ fresh)
            if low < high < values[0]:
                fresh = chebyshev(product, fresh, low, high, float(values[0]))
                fresh -= vectors @ (vectors.T @ fresh)
            outside, found, _ = _ritz(product, fresh)
            checked = True
            if outside[0] <= values[k - 1] * (1 + 1e-9):
                return values[:k], vectors[:, :k]
            values, vectors, gaps = _ritz(product, np.hstack([vectors, found]))
            best, stuck, checked = math.inf, 0, False
            continue
        if not low < high < values[0]:
            low = 0.0 if high > 0 else -1e-12 * top
            high = max(high, 1e-9 * top)
        values, vectors, gaps = _ritz(product, chebyshev(product, vectors, low, high, max(top, float(values[0]))))
    raise ArithmeticError("the components did not settle")


def whitened(vectors: DataFrame, k: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per usable vector and component."""
    folder = run_folder(vectors.sparkSession)
    source = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    kind = dict(source.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = settled(source.mapInArrow(_grid, f"vec_id {kind}, x array<long>"), folder, "rows")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = common["d"]
    rows = rows.where(F.size("x") == d)
    fit = Fit(settled(rows.select("x").distinct(), folder, "fit"), d)
    values, axes = leading(fit.product, d, k)
    trace = float(fit.passed(lambda x: np.array([(x * x).sum()]), 1)[0]) / fit.n
    some = values > 1e-12 * trace
    values, axes = values[some], axes[:, some]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    scaled, m = axes / np.sqrt(values), len(values)
    mean = fit.passed(lambda x: (x @ scaled).sum(0), m) / fit.n
    spread = fit.passed(lambda x: ((z := x @ scaled - mean).T @ z), m * m).reshape(m, m) / fit.n
    error, explained, n, sums = float(np.abs(spread - np.eye(m)).max()), values / trace, fit.n, fit.sums

    def project(batches: Batches) -> Batches:
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not len(x):
                continue
            gap = n * x - sums
            if (gap.astype(float) ** 2).sum(1).max() >= 2.0**63:
                raise OverflowError("a deviation does not fit a long")
            size = len(x) * m
            columns = [np.tile(np.arange(1, m + 1, dtype=np.int32), len(x)), np.full(size, n), np.repeat((gap * gap).sum(1), m), ((gap / n) @ scaled).ravel(), np.tile(explained, len(x)), np.full(size, error)]
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), m)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in columns)], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors on their 16 leading components."""
    return whitened(table(spark, folder, "embeddings"))
