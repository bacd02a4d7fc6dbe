"""Embedding whitening by incremental eigendecomposition.

A task keeps the spectrum of the vectors that it has seen: their number, mean, and the
eigenvalues and eigenvectors of their scatter.  Every addition is a centred rank-one update.
The new eigenvalues are the roots of a secular equation, after deflation has set aside the
directions that the update does not touch; the new eigenvectors follow from the roots.  Two
spectra are combined in the same way, one rank-one update for each eigenpair of the other and
one for the distance of the means, in a tree of tasks.

A block of vectors has the scatter of the triangular factor of its centred rows, so it takes
as many updates as there are dimensions, however many vectors it holds.

The combined eigenvectors are a basis, no more: a Rayleigh-Ritz step projects the covariance of
all vectors on it, with exact centring, and gives the components to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from textlab.storage import materialize

#: Components that are returned at most.
COMPONENTS = 32
#: Fixed point: an entry c becomes floor(SCALE * c) + SHIFT.
SCALE = 64
SHIFT = 1_000_000
#: Vectors that are condensed to one triangular factor.
BLOCK_ROWS = 16_384
#: Spectra that one task combines.
FAN_IN = 16
#: Entries of this size or more do not fit the exact arithmetic; they are an error.
LARGEST = float(1 << 40)

_BISECTIONS = 64
_EPS = float(np.finfo(float).eps)


def solve_secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of ``diag(d) + z z'`` for rising, distinct ``d`` and no zero in ``z``.

    The i-th root lies between d[i] and the next pole.  It is searched as the distance from
    the nearer of the two, so differences to poles keep their leading digits.
    """
    n = len(d)
    upper = np.append(d[1:], d[-1] + z @ z)
    width = upper - d
    squares = z * z

    def secular(origin: np.ndarray, step: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 + (squares / ((d[None, :] - origin[:, None]) - step[:, None])).sum(axis=1)

    # The function rises from -inf to +inf between two poles: where is the root?
    right = secular(d, width / 2) < 0
    right[-1] = False
    origin = np.where(right, upper, d)
    low, high = np.where(right, -width / 2, 0.0), np.where(right, 0.0, width / 2)
    high[-1] = width[-1]
    for _ in range(_BISECTIONS):
        middle = (low + high) / 2
        rising = secular(origin, middle) < 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    # Never on a pole: of the last interval, the end that is not zero.
    step = np.where(right, np.where(low < 0, low, -np.finfo(float).tiny), np.where(high > 0, high, np.finfo(float).tiny))
    gaps = (d[None, :] - origin[:, None]) - step[:, None]  # d[j] - root[i]
    # The roots are the exact eigenvalues of a near z; taking that one makes the vectors orthogonal.
    apart = d[None, :] - d[:, None]
    np.fill_diagonal(apart, 1.0)
    ratios = gaps / np.where(np.eye(n, dtype=bool), 1.0, apart.T)
    exact = np.sqrt(np.abs(np.prod(ratios, axis=0))) * np.where(z < 0, -1.0, 1.0)
    vectors = (exact[None, :] / gaps).T
    return origin + step, vectors / np.sqrt((vectors * vectors).sum(axis=0))


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``vectors diag(values) vectors' + v v'``; values are rising before and after.

    Deflation: directions at right angles to ``v`` keep their pair, and of several directions
    with the same eigenvalue all but one are turned to be at right angles to it.
    """
    z = v @ vectors
    size = max(float(values[-1]) if len(values) else 0.0, float(z @ z))
    if size == 0.0:
        return values, vectors
    values, vectors, z = values.copy(), vectors.copy(), z.copy()
    tolerance = 8 * _EPS * size
    touched = np.abs(z) * np.sqrt(float(z @ z)) > tolerance
    last = -1
    for i in np.flatnonzero(touched):
        if last >= 0 and values[i] - values[last] <= tolerance:
            r = np.hypot(z[i], z[last])
            c, s = z[i] / r, z[last] / r
            a, b = vectors[:, last].copy(), vectors[:, i].copy()
            vectors[:, last], vectors[:, i] = c * a - s * b, s * a + c * b
            z[last], z[i], touched[last] = 0.0, r, False
        last = i
    at = np.flatnonzero(touched)
    if len(at):
        values[at], turned = solve_secular(values[at], z[at])
        vectors[:, at] = vectors[:, at] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Number, mean and scatter (as rising eigenvalues and their vectors) of some vectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def _move(self, n: int, mean: np.ndarray) -> None:
        """The rank-one update between the means, when ``n`` vectors around another mean join."""
        apart = mean - self.mean
        if self.n:
            self.values, self.vectors = rank_one(
                self.values, self.vectors, apart * np.sqrt(self.n * n / (self.n + n))
            )
        self.mean = self.mean + apart * (n / (self.n + n))
        self.n += n

    def add(self, rows: np.ndarray) -> None:
        """More vectors, as rows."""
        if not len(rows):
            return
        mean = rows.mean(axis=0)
        centred = rows - mean
        self._move(len(rows), mean)
        condensed = centred if len(rows) <= rows.shape[1] else np.linalg.qr(centred, mode="r")
        for row in condensed:
            self.values, self.vectors = rank_one(self.values, self.vectors, row)

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        self._move(other.n, other.mean)
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector * np.sqrt(value))


_SPECTRUM = "part bigint, n bigint, mean array<double>, values array<double>, vectors array<double>"


def _as_rows(part: int, found: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array([part], pa.int64()),
            "n": pa.array([found.n], pa.int64()),
            "mean": [found.mean.tolist()],
            "values": [found.values.tolist()],
            "vectors": [found.vectors.ravel().tolist()],
        }
    )


def _from_row(row: dict) -> Spectrum:
    dims = len(row["mean"])
    return Spectrum(
        row["n"], np.array(row["mean"]), np.array(row["values"]), np.array(row["vectors"]).reshape(dims, dims)
    )


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, odd)


def _entries(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as one row of doubles for each vector."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def fixed_point(entries: np.ndarray) -> np.ndarray:
    if entries.size and np.abs(entries).max() >= LARGEST:
        raise ValueError(f"an entry of {LARGEST:g} or more")
    return np.floor(SCALE * entries).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            rows = batch.slice(at, BLOCK_ROWS)
            yield rows.column("_id"), fixed_point(_entries(rows.column("_v"), dims))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: 64-bit where that is enough, else Python's integers."""
    most = max(int(np.abs(x).max()) if x.size else 0, 1)
    if n * most < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(t: np.ndarray) -> list[int]:
    """Sum of squares of each row, exactly."""
    most = int(np.abs(t).max()) if t.size else 0
    if most * most * t.shape[1] >= 1 << 62:
        t = t.astype(object)
    return [int(s) for s in (t * t).sum(axis=1)]


def exact_sums(vectors: DataFrame, dims: int) -> list[int]:
    """Sum of the fixed-point vectors per dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, object)
        for _, x in _blocks(batches, dims):
            total += x.sum(axis=0).astype(object)
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array([Decimal(int(s)) for s in total], kind)], ["at", "s"]
        )

    rows = vectors.mapInArrow(add, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()
    found = {r["at"]: int(r["s"]) for r in rows}
    return [found.get(i, 0) for i in range(dims)]


def spectrum(vectors: DataFrame, dims: int) -> Spectrum:
    """The spectrum of all vectors: one in each task, then combined ``FAN_IN`` at a time."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum.empty(dims)
        for _, x in _blocks(batches, dims):
            # The shift has no part in the scatter; without it means keep more digits.
            found.add((x - SHIFT).astype(float))
        if found.n:
            yield _as_rows(TaskContext.get().partitionId(), found)

    def combine(rows: pa.Table) -> pa.Table:
        listed = sorted(rows.to_pylist(), key=lambda r: r["part"])
        found = _from_row(listed[0])
        for row in listed[1:]:
            found.merge(_from_row(row))
        return pa.Table.from_batches([_as_rows(listed[0]["part"] // FAN_IN, found)])

    parts = materialize(vectors.mapInArrow(follow, _SPECTRUM), "spectra")
    while parts.count() > 1:
        group = F.floor(F.col("part") / FAN_IN).cast("bigint").alias("_group")
        parts = materialize(parts.groupBy(group).applyInArrow(combine, _SPECTRUM), "spectra")
    return _from_row(parts.first().asDict())


def projected_scatter(vectors: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """``basis' V basis`` for the covariance V of all vectors, each centred before it is multiplied."""
    dims, width = basis.shape
    row, col = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in _blocks(batches, dims):
            y = (centred(x, n, sums) / n).astype(float) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(total[row, col])], ["i", "j", "t"]
        )

    found = vectors.mapInArrow(add, "i int, j int, t double").groupBy("i", "j").agg(F.sum("t").alias("t")).collect()
    out = np.zeros((width, width))
    for i, j, t in found:
        out[i, j] = out[j, i] = t
    return out / n


@dataclass(frozen=True)
class Whitening:
    """What :func:`fit` has found: ``axes`` has a component in each column."""

    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(vectors: DataFrame, dims: int, n: int, components: int) -> Whitening:
    """Components of the usable vectors ``_id, _v``.

    The driver holds matrices of ``dims`` by ``dims`` numbers, whatever the number of vectors.
    """
    sums = exact_sums(vectors, dims)
    basis, _ = np.linalg.qr(spectrum(vectors, dims).vectors)
    values, turned = np.linalg.eigh(projected_scatter(vectors, n, sums, basis))
    order = np.argsort(-values, kind="stable")
    values, axes = values[order], basis @ turned[:, order]
    trace = float(values.sum())
    spread = int((values > dims * _EPS * max(trace, 0.0)).sum())
    kept = min(components, spread)
    values, axes = values[:kept], axes[:, :kept]
    error = 0.0
    if kept:
        again = projected_scatter(vectors, n, sums, axes / np.sqrt(values))
        error = float(np.abs(again - np.eye(kept)).max())
    return Whitening(n, sums, axes, values, values / trace if kept else values, error)


def whiten(
    embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row for each usable vector and component: ``id_col, component, n, deviation, whitened,
    explained, identity_error``.

    Vectors that are null or hold null, NaN or infinite entries are left out; the others must
    have one length, entries below 2 ** 40, and at least one entry, or it is an error.  All of
    them are fitted and all are returned; equal vectors and repeated or null ids are rows of
    their own.  Directions without any spread have no component, so one vector, or many equal
    ones, give no rows, as an empty table does.  Other columns are not looked at.

    ``deviation`` is exact: ``decimal(38, 0)``.  Components are numbered from 1 by falling
    eigenvalue; their sign is arbitrary, the same for all rows.
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    source = embeddings.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).filter(usable(F.col("_v")))
    schema = (
        f"_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
        "identity_error double"
    )
    n, shortest, longest = source.agg(F.count("*"), F.min(F.size("_v")), F.max(F.size("_v"))).first()
    if not n:
        return embeddings.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    if shortest != longest or not shortest:
        raise ValueError(f"vectors of {shortest} to {longest} entries")
    found = fit(source, longest, n, components)
    kept, sums, projection = len(found.eigenvalues), found.sums, found.axes / np.sqrt(found.eigenvalues)
    explained, error = found.explained, found.identity_error

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, longest):
            t = centred(x, n, sums)
            white = (t / n).astype(float) @ projection
            deviation = pa.array([Decimal(s) for s in _squares(t)], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(x)), kept))
            rows = len(x) * kept
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(each),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(rows, n, np.int64)),
                    deviation.take(each),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(rows, error)),
                ],
                ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return source.mapInArrow(project, schema).withColumnRenamed("_id", id_col)
