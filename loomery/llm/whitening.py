"""Whitening of embeddings: streamed moments, merged across partitions, and a symmetric QR eigen-solve.

Entries go onto a grid of whole numbers, x = floor(256 * entry). Each distinct grid vector counts once: the fit list is the
distinct keys of one pre-aggregated shuffle, so copies of a vector, however many, are no burden. Each partition of the fit
list runs Welford's rank-one updates over its rows and yields one state: number, mean, scatter about the mean, and exact
sums. States are merged sixteen at a time by the parallel update formula, in as many rounds as it takes, so the driver gets
one matrix whose size depends on the dimensions alone. There it is made tridiagonal by Householder reflections and solved by
implicit symmetric QR steps with Wilkinson's shift. A second pass over the fit list measures the covariance of the result.

Defined results: vectors that are null, empty, or hold null or non-finite entries take no part. Where lengths differ, those
that most distinct grid vectors have count (of equally many the longer) and the others take no part. Grid values beyond 64
bits are held to their range. Directions in which the fit list does not vary cannot be whitened and are left out, so one
distinct vector, or an empty table, gives no rows. Rows that repeat an id, or have none, are rows of their own. Extra columns
are carried along; new names that a table has already take underscores in front. A deviation of more than 38 digits is null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.llm.shared import Scratch, free_name, lean, quoted

SCALE, COMPONENTS = 256, 4
MERGED = 16
FLAT = 1e-12  # eigenvalues below this share of the largest are rounding
HALF = 32


def grid(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * value) as 64-bit integers."""
    return np.clip(np.floor(values * float(scale)), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def whole_rows(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, values) for each length: the rows of an Arrow list column whose entries are all there and finite."""
    import pyarrow as pa

    offsets = column.offsets.to_numpy()
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    odd = np.r_[0, np.cumsum(~np.isfinite(flat))]
    sizes = np.diff(offsets)
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0) & (odd[offsets[1:]] == odd[offsets[:-1]])
    out = []
    for n in np.unique(sizes[whole]):
        places = np.flatnonzero(whole & (sizes == n))
        out.append((places, flat[offsets[places][:, None] + np.arange(n)]))
    return out


def packed_keys(x: np.ndarray) -> list[bytes]:
    """Each row as little-endian integers of the least width that holds it, so equal rows have equal keys."""
    top = np.maximum(x.max(axis=1), -1 - x.min(axis=1))
    out = [b""] * len(x)
    for bits, low in ((16, -1), (32, 2**15 - 1), (64, 2**31 - 1)):
        for i in np.flatnonzero((top > low) & (top < 2 ** (bits - 1)) if bits < 64 else top > low):
            out[i] = x[i].astype(f"<i{bits // 8}").tobytes()
    return out


def unpacked_keys(keys: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(keys), dims), np.int64)
    for i, k in enumerate(keys):
        out[i] = np.frombuffer(k, f"<i{len(k) // dims}")
    return out


class Moments:
    """Number, mean, scatter about the mean and exact sums of vectors, by Welford's updates; sums are in two halves."""

    def __init__(self, dims: int):
        self.n, self.mean, self.scatter = 0, np.zeros(dims), np.zeros((dims, dims))
        self.high, self.low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        self._square = np.empty((dims, dims))

    def add(self, rows: np.ndarray) -> None:
        """Rank-one updates, a row at a time."""
        n, mean, scatter, square = self.n, self.mean, self.scatter, self._square
        for x in rows.astype(np.float64):
            delta = x - mean
            mean += delta / (n + 1)
            np.multiply(delta[:, None], delta * (n / (n + 1)), out=square)
            scatter += square
            n += 1
        self.n = n
        if rows.dtype == np.int64:
            self.high += (rows >> HALF).sum(axis=0)
            self.low += (rows & ((1 << HALF) - 1)).sum(axis=0)
            self._carry()

    def _carry(self) -> None:
        self.high += self.low >> HALF
        self.low &= (1 << HALF) - 1

    def merge(self, other: "Moments") -> None:
        """The parallel update of Chan, Golub and LeVeque."""
        n = self.n + other.n
        if other.n:
            delta = other.mean - self.mean
            self.mean = self.mean + delta * (other.n / n)
            self.scatter += other.scatter + np.outer(delta, delta) * (self.n * (other.n / n))
            self.high += other.high
            self.low += other.low
            self._carry()
        self.n = n

    def sums(self) -> list[int]:
        return [(int(h) << HALF) + int(w) for h, w in zip(self.high, self.low)]

    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * max(1, self.n))

    def state(self) -> list:
        return [self.n, self.mean.tobytes(), self.scatter.tobytes(), self.high.tobytes(), self.low.tobytes()]

    @classmethod
    def of(cls, state) -> "Moments":
        n, *parts = state
        out = cls(len(parts[0]) // 8)
        mean, scatter = (np.frombuffer(p, "<f8") for p in parts[:2])
        out.n, out.mean, out.scatter = n, mean.copy(), scatter.reshape(out.scatter.shape).copy()
        out.high, out.low = (np.frombuffer(p, "<i8").copy() for p in parts[2:])
        return out


def moments(vectors: DataFrame, dims: int, read) -> Moments:
    """The moments of all rows; read gives a batch's rows as a matrix of dims columns and runs on the executors."""
    import pyarrow as pa

    schema = "n long, mean binary, scatter binary, high binary, low binary"
    fields = pa.schema([("n", pa.int64()), *[(c, pa.binary()) for c in ("mean", "scatter", "high", "low")]])

    def yielded(total):
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(total.state(), fields)], schema=fields)

    def gather(batches):
        total = Moments(dims)
        for batch in batches:
            total.add(read(batch))
        if total.n:
            yield yielded(total)

    def merge(batches):
        total = Moments(dims)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                total.merge(Moments.of(row))
        if total.n:
            yield yielded(total)

    states, parts = vectors.mapInArrow(lean(gather), schema), vectors.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // MERGED)
        states = states.repartition(parts).mapInArrow(lean(merge), schema)
    total = Moments(dims)
    for row in states.collect():  # one row, of the dimensions' size
        total.merge(Moments.of(tuple(row)))
    return total


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with q.T @ a @ q tridiagonal, by Householder reflections."""
    a, n = np.array(a, np.float64), len(a)
    q, least = np.eye(n), np.finfo(float).eps ** 2 * np.abs(a).max()
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if np.abs(v[1:]).max() <= least:
            continue
        v /= np.abs(v).max()  # small numbers would lose their squares
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= np.outer(2 * v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, 2 * v)
        q[:, k + 1 :] -= np.outer(q[:, k + 1 :] @ v, 2 * v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, each with its largest entry positive."""
    diagonal, off, q = tridiagonal(a)
    d, e, rows = diagonal.tolist(), off.tolist(), np.ascontiguousarray(q.T)
    eps, last = np.finfo(float).eps, len(d) - 1
    for _ in range(60 * len(d) + 1):
        for i in range(last):
            if abs(e[i]) <= eps * math.sqrt(abs(d[i])) * math.sqrt(abs(d[i + 1])) or abs(e[i]) < 1e-290:
                e[i] = 0.0
        while last > 0 and e[last - 1] == 0:
            last -= 1
        if last <= 0:
            break
        first = last - 1
        while first > 0 and e[first - 1] != 0:
            first -= 1
        half = (d[last - 1] - d[last]) / 2
        shift = d[last] - e[last - 1] ** 2 / (half + math.copysign(math.hypot(half, e[last - 1]), half))
        x, z = d[first] - shift, e[first]
        for k in range(first, last):  # the bulge is chased down the diagonal
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            a1, a2, b = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * a1 + 2 * c * s * b + s * s * a2, s * s * a1 - 2 * c * s * b + c * c * a2
            e[k] = c * s * (a2 - a1) + (c * c - s * s) * b
            if k < last - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            rows[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ rows[[k, k + 1]]
    else:
        raise ArithmeticError("the eigenvalues did not settle")
    order = np.argsort(-np.array(d), kind="stable")
    vectors = rows[order].T
    return np.array(d)[order], vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(d))] < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """What is fitted: n distinct grid vectors of dims entries with exact sums, and the directions that vary most."""

    n: int
    dims: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    trace: float
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ (self.directions / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """The sum over dimensions of (n * x - S) ** 2, exact at any size."""
        most = self.n * max(int(x.max()), -int(x.min())) + max(map(abs, self.sums))
        if most * most * self.dims < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1)
        return [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x]


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """Fits on each distinct grid vector of the table once."""
    import pyarrow as pa

    def keyed(batches):
        for batch in batches:
            for _, values in whole_rows(batch.column(0)):
                n = values.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(values), pa.int32()), pa.array(packed_keys(grid(values, scale)), pa.binary())], names=["dims", "x"])

    held = Scratch(vectors.sparkSession)
    column = vectors.select(F.col(quoted(vector_col)).cast("array<double>").alias("v"))
    distinct = held.written(column.mapInArrow(lean(keyed), "dims int, x binary").distinct(), "whitening")
    commonest = distinct.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not commonest:
        held.clear()
        return Whitening(0, 0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    dims = commonest[0].dims
    fit = distinct.where(F.col("dims") == dims).select("x")
    total = moments(fit, dims, lambda batch: unpacked_keys(batch.column(0).to_pylist(), dims))
    values, directions = symmetric_qr(total.covariance())
    many = min(components, int((values > FLAT * max(values[0], 0)).sum())) if values[0] > 0 else 0
    model = Whitening(total.n, dims, total.sums(), values[:many], directions[:, :many], float(total.covariance().trace()))
    if many:
        again = moments(fit, many, lambda batch: model.project(unpacked_keys(batch.column(0).to_pylist(), dims)))
        model.identity_error = float(np.abs(again.covariance() - np.eye(many)).max())
    held.clear()
    return model


def whiten(vectors: DataFrame, model: Whitening, vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The rows that take part, with whitened array<double> (a value for each component) and deviation decimal(38, 0)."""
    import pyarrow as pa

    white, far = (free_name(vectors, c) for c in ("whitened", "deviation"))
    plain = vectors.withColumn(free_name(vectors, "entries"), F.col(quoted(vector_col)).cast("array<double>"))
    plain = plain.toDF(*[f"c{i}" for i in range(len(plain.columns))])  # dotted names are no names of columns to mapInArrow
    added = [T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.DecimalType(38, 0))]
    schema = T.StructType([*plain.schema.fields[:-1], *added])
    if not len(model.values):
        return vectors.where(F.lit(False)).select("*", F.lit(None).cast("array<double>").alias(white), F.lit(None).cast("decimal(38,0)").alias(far))

    def digits(deviations):
        import decimal

        if isinstance(deviations, np.ndarray):
            return pa.array(deviations, pa.int64()).cast(pa.decimal128(38, 0))
        return pa.array([decimal.Decimal(v) if v < 10**38 else None for v in deviations], pa.decimal128(38, 0))

    def projected(batches):
        for batch in batches:
            entries = batch.column(batch.num_columns - 1)
            for places, values in whole_rows(entries):
                if values.shape[1] == model.dims:
                    x = grid(values, scale)
                    flat = pa.array(model.project(x).ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(model.values)), flat)
                    own = [c.take(pa.array(places)) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*own, lists, digits(model.deviations(x))], names=schema.names)

    return plain.mapInArrow(lean(projected), schema).toDF(*vectors.columns, white, far)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit_whitening(vectors)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
