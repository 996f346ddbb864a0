"""Whitened embeddings by a cyclic Jacobi eigensolver.

Entries become integers, ``x = floor(scale * c) + offset``, so that counts and sums are exact. Tasks add up centred scatter matrices
(``x - S/n``, centred before multiplying: the whole part of the mean is taken off in integers, the rest in doubles), one row per pair of
dimensions and task; the driver, which holds one matrix of the vectors' dimension, turns it by Jacobi rotations until
every off-diagonal entry is negligible beside the two diagonal entries of its rows, which keeps small eigenvalues accurate to their
own size. Components are sorted by falling eigenvalue; the matrix that projects and scales is sent to the tasks with the function. A further pass
measures the covariance of what was whitened.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are dropped, and so are rows whose vector has another length than
most (ties: the longer; vectors without entries count as no vectors); ids are only carried, so null ids, repeated rows and ids of any type stay; a dimension of constant
value adds nothing; directions without variance (eigenvalue below ``dimension * 2.3e-16 * trace``) cannot be scaled to unit variance and are left
out, so that equal vectors, or a single one, give no components at all; of equal eigenvalues any orthonormal directions are taken, the
same for all rows; entries beyond 2^62 / scale count as that bound; a deviation of over 38 digits is null; an empty table gives an empty result;
other columns pass through, but one named as ``out`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.session import materialize, ship

EDGE = 2.0**62


def rotated(matrix: np.ndarray, p: np.ndarray, q: np.ndarray, vectors: np.ndarray) -> bool:
    """One step in place: the rotations of the disjoint pairs (p, q). False if all their entries are negligible."""
    app, aqq, apq = matrix[p, p], matrix[q, q], matrix[p, q]
    eps = np.finfo(float).eps
    live = np.abs(apq) > np.maximum(eps * np.sqrt(np.abs(app * aqq)), eps * eps * np.abs(np.trace(matrix)))
    if not live.any():
        return False
    p, q, app, aqq, apq = p[live], q[live], app[live], aqq[live], apq[live]
    with np.errstate(over="ignore"):
        theta = (aqq - app) / (2 * apq)
        t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.sqrt(theta * theta + 1))
    c = 1 / np.sqrt(t * t + 1)
    s = t * c
    for side in (matrix, matrix.T, vectors.T):
        low, high = side[p].copy(), side[q].copy()
        side[p] = c[:, None] * low - s[:, None] * high
        side[q] = s[:, None] * low + c[:, None] * high
    matrix[p, p], matrix[q, q] = app - t * apq, aqq + t * apq
    matrix[p, q] = matrix[q, p] = 0.0
    return True


def cyclic_jacobi(symmetric: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, each with its largest entry positive.

    A sweep meets every pair of dimensions once, in rounds of disjoint pairs (a round-robin order), each round one numpy step.
    """
    a = np.array(symmetric, dtype=float)
    d = len(a)
    vectors = np.eye(d)
    seats = np.arange(d + d % 2)
    for _ in range(most_sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            pairs = np.sort(np.stack([seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]]), axis=0)
            pairs = pairs[:, pairs[1] < d]
            turned |= rotated(a, pairs[0], pairs[1], vectors)
            seats[1:] = np.roll(seats[1:], 1)
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    vectors = vectors[:, order]
    if d:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return np.diag(a)[order], vectors


def integers(column: pa.Array, dim: int, scale: int, offset: int) -> np.ndarray:
    """x of a batch of valid vectors, one row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(scale * flat), -EDGE, EDGE).astype(np.int64).reshape(-1, dim) + offset


@dataclass(frozen=True)
class Centre:
    """Count and exact sums of x, and how entries become x."""

    n: int
    sums: tuple[int, ...]
    scale: int
    offset: int

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the whole part of the mean, as integers, and x - S/n in doubles."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        y = x - whole
        return y, y - rest

    def deviation(self, y: np.ndarray) -> pa.Array:
        """The sum of (n*x - S)^2 of each row, exact: n^2 sum(y^2) - 2 n sum(r*y) + sum(r^2) with r = S mod n."""
        rests = [s % self.n for s in self.sums]
        far, widest = int(np.abs(y).max(initial=0)), max(rests, default=0)
        small = y.shape[1] * far * max(far, widest) < 1 << 62
        y, r = (y, np.array(rests, dtype=np.int64)) if small else (y.astype(object), np.array(rests, dtype=object))
        squares, mixed, last = (y * y).sum(axis=1), (y * r).sum(axis=1), sum(v * v for v in rests)
        if small and self.n * self.n * int(squares.max(initial=0)) + 2 * self.n * int(np.abs(mixed).max(initial=0)) + last < 1 << 62:
            return pa.array(self.n * self.n * squares - 2 * self.n * mixed + last, pa.int64()).cast(pa.decimal128(38, 0))
        exact = (self.n * self.n * int(a) - 2 * self.n * int(b) + last for a, b in zip(squares, mixed, strict=True))
        return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def usable(vector: Column) -> Column:
    """Whether the vector has entries, all of them finite numbers."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def fitted_centre(vectors: DataFrame, scale: int, offset: int) -> tuple[int, Centre]:
    """The usual dimension of vectors(v) and their exact count and sums; dimension 0 for no vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                x = integers(column.filter(pa.array(lengths == dim)), int(dim), scale, offset)
                high, low = x >> 31, x & ((1 << 31) - 1)  # sums of the halves cannot overflow within a batch
                sums = [(int(a) << 31) + int(b) for a, b in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]
                n, before = totals.get(int(dim), (0, [0] * int(dim)))
                totals[int(dim)] = (n + len(x), [a + b for a, b in zip(before, sums, strict=True)])
        rows = [(dim, at, n, Decimal(s)) for dim, (n, sums) in totals.items() for at, s in enumerate(sums)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["dim", "at", "n", "s"])

    ship(vectors.sparkSession)
    parts = materialize(vectors.mapInArrow(run, "dim int, at int, n long, s decimal(38,0)"), "vector-sums")
    usual = parts.where("at = 0").groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if usual is None:
        return 0, Centre(0, (), scale, offset)
    found = parts.where(F.col("dim") == usual.dim).groupBy("at").agg(F.sum("s").alias("s")).collect()  # one row per dimension
    by = {r["at"]: int(r.s) for r in found}
    return usual.dim, Centre(usual.n, tuple(by[i] for i in range(usual.dim)), scale, offset)


def scatter(vectors: DataFrame, width: int, rows_of: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """The sum of outer products of rows_of(v), a matrix of width * width: tasks add up their own, one row per pair of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = rows_of(batch.column(0))
            total += y.T @ y
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "value"])

    found = vectors.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((width, width))
    out[found["i"], found["j"]] = out[found["j"], found["i"]] = found["value"]
    return out


def whiten(df: DataFrame, vector_col: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000, out: str = "whitening") -> DataFrame:
    """The rows with a usable vector, and struct ``out``: n, deviation, values and explained (arrays by component), identity_error."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c.lower() != out.lower()]
    rows = df.select(F.struct(*kept).alias("row"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    vectors = rows.select("v")
    dim, centre = fitted_centre(vectors, scale, offset)
    of_dim = F.size("v") == dim
    n = max(centre.n, 1)

    def doubles(column: pa.Array) -> np.ndarray:
        return centre.centred(integers(column, dim, scale, offset))[1]

    covariance = scatter(vectors.where(of_dim), dim, doubles) / n if dim else np.zeros((0, 0))
    values, directions = cyclic_jacobi(covariance)
    trace = float(np.trace(covariance))
    count = min(components, int((values > dim * np.finfo(float).eps * trace).sum()))
    project = directions[:, :count] / np.sqrt(values[:count])

    def white(column: pa.Array) -> np.ndarray:
        return doubles(column) @ project

    off = scatter(vectors.where(of_dim), count, white) / n - np.eye(count) if count else np.zeros((1, 1))
    error = float(np.abs(off).max())

    def both(column: pa.Array) -> pa.Array:
        y, exact = centre.centred(integers(column, dim, scale, offset))
        z = exact @ project
        ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * count, pa.int32())
        return pa.StructArray.from_arrays([centre.deviation(y), pa.ListArray.from_arrays(ends, pa.array(z.reshape(-1)))], names=["deviation", "values"])

    made = F.arrow_udf(both, "struct<deviation:decimal(38,0),values:array<double>>")("v") if count else F.lit(None).cast("struct<deviation:decimal(38,0),values:array<double>>")
    explained = F.array(*[F.lit(float(v / trace)) for v in values[:count]]).cast("array<double>")
    result = rows.where(of_dim).select("row", made.alias("made"))
    fields = [F.lit(centre.n).cast("long").alias("n"), F.col("made.deviation"), F.coalesce("made.values", F.array().cast("array<double>")).alias("values"), explained.alias("explained"), F.lit(error).alias("identity_error")]
    return result.select(*[F.col("row").getField(c).alias(c) for c in kept], F.struct(*fields).alias(out))
