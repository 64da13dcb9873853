"""Embedding whitening: principal components of distinct vectors, found by rank-one updates of partial spectra.

1. Vectors become whole numbers ``floor(scale * c) + offset``; each distinct one is in the fit list once.
2. Part: the fit list is dealt into slots. Each slot takes its vectors one by one: the mean moves, and the spectrum of
   the scatter matrix is updated by the centred vector. The new eigenvalues are the roots of the secular equation
   ``1/rho + sum z_j^2 / (d_j - t) = 0``, one between each two old ones; entries that are too small, or belong to equal
   eigenvalues, are deflated first. New eigenvectors come from the roots by Loewner's formula, so they stay orthogonal.
3. Together: two spectra are added by updating the one with each scaled eigenvector of the other and with the difference
   of their means, in groups of a bounded number of slots.
4. Refinement: the covariance in the basis found (Rayleigh quotients, summed over partitions from exactly centred
   vectors) is diagonal but for rounding; its eigenvectors turn the basis into the final one.

A vector counts if it is not null, has as many entries as most vectors have (of several such numbers the largest), and
no null, non-finite or larger entry than ``LARGEST``; others are left out. Components whose variance is zero but for
rounding are left out, so equal vectors alone give no rows, as do empty tables. Repeated rows are returned each; a null id
stays null. Other columns are not read, so their names cannot clash. The driver holds matrices of the entries' number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.fold import STATES, fold
from tallyhouse.sources.workspace import materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
SLOT_ROWS = 2048
#: Entries beyond it have no exact product with the number of vectors.
LARGEST = float(1 << 44)
#: A component's least share of the variance.
LEAST_SHARE = 1e-13
EPS = np.finfo(float).eps
ROUNDS = 60


def roots(d: np.ndarray, z2: np.ndarray, rho: float) -> np.ndarray:
    """``d_j - t_i`` (a row for each root t_i) of ``1/rho + sum z2_j / (d_j - t) = 0``; d rises, sum z2 is 1.

    A root is sought as its distance from the nearer pole, so differences keep their digits. Each round fits a
    function with the two poles around the root to value and slopes; steps that leave the bracket halve it.
    """
    k = len(d)
    right = np.append(d[1:], d[-1] + rho)
    middle = (d + right) / 2
    at_middle = 1 / rho + (z2 / (d - middle[:, None])).sum(axis=1)
    near = np.arange(k)
    near[:-1] += at_middle[:-1] < 0
    delta = d - d[near][:, None]
    half = (right - d) / 2
    left_of = near == np.arange(k)
    low, high = np.where(left_of, 0.0, -half), np.where(left_of, half, 0.0)
    low[-1], high[-1] = 0.0, rho
    if at_middle[-1] < 0:
        low[-1] = half[-1]
    mu = (low + high) / 2
    lower = np.tri(k, dtype=bool)
    rows, after = np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
    for _ in range(ROUNDS):
        gap = delta - mu[:, None]
        part = z2 / gap
        slope = part / gap
        f = 1 / rho + part.sum(axis=1)
        low, high = np.where(f < 0, mu, low), np.where(f < 0, high, mu)
        size = 1 / rho + np.abs(part).sum(axis=1)
        psi = np.where(lower, slope, 0).sum(axis=1)
        phi = slope.sum(axis=1) - psi
        a1, a2 = gap[rows, rows], gap[rows, after]
        c = f - a1 * psi - a2 * phi
        a = (a1 + a2) * f - a1 * a2 * (psi + phi)
        b = a1 * a2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # The last root has one pole only: c + s / (d - t).
            s = psi[-1] * a1[-1] ** 2
            step[-1] = a1[-1] + s / (f[-1] - s / a1[-1])
        new = mu + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        done = (np.abs(f) <= 4 * EPS * size) | (np.abs(new - mu) <= 2 * EPS * np.abs(mu))
        mu = np.where(np.abs(f) <= 4 * EPS * size, mu, new)
        if done.all():
            break
    return delta - mu[:, None]


@dataclass
class Spectrum:
    """Scatter ``basis @ diag(values) @ basis.T`` of ``n`` vectors around ``mean``; values rise."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @staticmethod
    def empty(dims: int) -> Spectrum:
        return Spectrum(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def dump(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.basis.ravel()]).tobytes()

    @staticmethod
    def load(data: bytes, dims: int) -> Spectrum:
        x = np.frombuffer(data)
        return Spectrum(int(x[0]), x[1 : dims + 1].copy(), x[dims + 1 : 2 * dims + 1].copy(), x[2 * dims + 1 :].reshape(dims, dims).copy())

    def update(self, v: np.ndarray, rho: float = 1.0) -> None:
        """Adds ``rho * v v'`` to the scatter."""
        z = self.basis.T @ v
        norm = float(np.sqrt(z @ z))
        if not norm:
            return
        z, rho = z / norm, rho * norm * norm
        d = self.values
        limit = 8 * EPS * max(abs(d[-1]), rho)
        # Deflation: of eigenvalues that are as good as equal, a rotation leaves one with a weight.
        close = np.flatnonzero(d[1:] - d[:-1] <= limit)
        for i in close.tolist():
            r = np.hypot(z[i], z[i + 1])
            if r and z[i]:
                c, s = z[i + 1] / r, z[i] / r
                z[i], z[i + 1] = 0.0, r
                one, two = self.basis[:, i].copy(), self.basis[:, i + 1]
                self.basis[:, i], self.basis[:, i + 1] = c * one - s * two, s * one + c * two
        live = np.flatnonzero(rho * np.abs(z) > limit)
        if not len(live):
            return
        dk, zk = d[live], z[live]
        gaps = roots(dk, zk * zk / (zk @ zk), rho * (zk @ zk))
        k = len(live)
        # Loewner: the weights for which these roots are exact.
        # Root j is paired with pole j for later weights, else with pole j + 1; the last root stands alone.
        before = np.tri(k, k, -1, dtype=bool).T
        paired = np.where(before, dk[:, None], np.append(dk[1:], 0)[:, None]) - dk
        paired[-1] = 1
        weight = np.sqrt(np.abs((-gaps / paired).prod(axis=0)))
        vectors = np.copysign(weight, zk)[:, None] / gaps.T
        vectors /= np.sqrt((vectors * vectors).sum(axis=0))
        self.basis[:, live] = self.basis[:, live] @ vectors
        pick = np.abs(gaps).argmin(axis=1)
        self.values = d.copy()
        self.values[live] = dk[pick] - gaps[np.arange(k), pick]
        order = np.argsort(self.values, kind="stable")
        self.values, self.basis = self.values[order], self.basis[:, order]

    def add(self, v: np.ndarray) -> None:
        """Takes one more vector."""
        away = v - self.mean
        self.update(away, self.n / (self.n + 1))
        self.n += 1
        self.mean += away / self.n

    def join(self, other: Spectrum) -> None:
        """Takes the vectors of another spectrum."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.basis = other.n, other.mean, other.values, other.basis
            return
        for value, v in zip(other.values.tolist(), other.basis.T):
            if value > 0:
                self.update(v, value)
        away, n = other.mean - self.mean, self.n + other.n
        self.update(away, self.n * other.n / n)
        self.mean += away * (other.n / n)
        self.n = n


def whole_numbers(rows: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int]:
    """Rows (id, x) of the vectors that count, and how many entries they have."""
    v = F.col("v")
    usable = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= LARGEST))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    kept = rows.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).where(v.isNotNull() & usable)
    common = kept.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common["dims"] if common else 0
    return kept.where(F.size("v") == dims).select("id", x.alias("x")), dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def by_partition(df: DataFrame, work, dims: int) -> DataFrame:
    """States of partitions: ``work`` turns x-vectors into a matrix, these are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + work(matrix(batch.column("x"), dims))
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())],
                                             ["part", "state"])

    return df.select("x").mapInArrow(run, STATES)


def summed(df: DataFrame, work, dims: int, shape: tuple[int, ...], kind: type = float) -> np.ndarray:
    plus = lambda a, b: (np.frombuffer(a, kind) + np.frombuffer(b, kind)).tobytes()
    state = fold(by_partition(df, work, dims), plus, "sums")
    return np.frombuffer(state, kind).reshape(shape) if state else np.zeros(shape, kind)


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S/n, each entry rounded once."""
    return (n * x - total) / n


def spectrum_of(fit: DataFrame, n: int, total: np.ndarray, slot_rows: int) -> Spectrum:
    """Eigenvalues and vectors of the fit list's scatter, by updates in slots that are then added."""
    dims, near = len(total), total // n
    slots = -(-n // slot_rows)

    def update(table: pa.Table) -> pa.Table:
        spectrum = Spectrum.empty(dims)
        for row in matrix(table["x"], dims) - near:
            spectrum.add(row.astype(float))
        return pa.table({"part": [table["part"][0].as_py()], "state": pa.array([spectrum.dump()], pa.binary())})

    def join(a: bytes, b: bytes) -> bytes:
        one = Spectrum.load(a, dims)
        one.join(Spectrum.load(b, dims))
        return one.dump()

    dealt = fit.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(slots)))
    return Spectrum.load(fold(dealt.groupBy("part").applyInArrow(lambda t: update(t), STATES), join, "spectra"), dims)


def whitened(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
             slot_rows: int = SLOT_ROWS) -> DataFrame:
    """A row for each vector that counts and each of the first ``components``: the id column, component (from 1), n (vectors
    in the fit list), deviation (sum of (n*x - S)^2), whitened, explained (share of the variance) and identity_error (one
    value: how far the covariance of the whitened fit list is from the identity at most)."""
    kind = rows.schema[id_column].dataType.simpleString()
    schema = "id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(kind)
    x, dims = whole_numbers(rows, id_column, vector)
    nothing = rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    if not dims:
        return nothing
    fit = materialize(x.select("x").distinct(), "fit_list")
    n = fit.count()
    total = summed(fit, lambda m: m.sum(axis=0), dims, (dims,), np.int64)
    basis = np.linalg.qr(spectrum_of(fit, n, total, slot_rows).basis)[0]

    def quotients(m: np.ndarray) -> np.ndarray:
        y = centred(m, n, total) @ basis
        return y.T @ y

    quotient = summed(fit, quotients, dims, (dims, dims)) / n
    values, turn = np.linalg.eigh((quotient + quotient.T) / 2)
    trace = float(np.trace(quotient))
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    k = int((values[:components] > LEAST_SHARE * trace).sum()) if trace > 0 else 0
    if not k:
        return nothing
    values, vectors = values[:k], vectors[:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    scaled = vectors / np.sqrt(values)

    def moments(m: np.ndarray) -> np.ndarray:
        w = centred(m, n, total) @ scaled
        return np.concatenate([w.T @ w, w.sum(axis=0)[None]])

    got = summed(fit, moments, dims, (k + 1, k)) / n
    error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = n * matrix(batch.column("x"), dims) - total
            if float((away.astype(float) ** 2).sum(axis=1).max()) > 9e18:
                raise OverflowError("a deviation does not fit a long")
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n)), pa.array(np.repeat((away * away).sum(axis=1), k)),
                pa.array(((away / n) @ scaled).ravel()), pa.array(np.tile(values / trace, rows)), pa.array(np.full(rows * k, error)),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(project, schema).withColumnRenamed("id", id_column)
