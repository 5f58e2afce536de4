"""Embedding whitening from a covariance that is exact up to its last division.

Entries become whole numbers x = floor(scale * c) + shift.  A first pass sums them per dimension; a
second squares the centred values y = n * x - S, also whole, for every dimension and for the sum of
every two.  By polarisation 2 * y_i * y_j = (y_i + y_j)^2 - y_i^2 - y_j^2, so differences of these
sums of squares are all covariances, times n^3, without an error; only then are they made doubles
for ``eigh``.  Sums of squares leave a task in limbs of 60 bits that Spark adds, so neither the
number of rows nor the size of the entries bounds them.  What reaches the driver is a few numbers
per pair of dimensions.  Rows are never shuffled.

Defined cases: vectors that are null, empty, or hold null or non-finite entries, or entries whose x
does not fit 64 bits, take no part.  Vectors of another length than the commonest one (of equally
common ones the longest) have no place in the matrix and take no part either.  Repeated rows and
ids count each; a null id is kept.  A component without variance (at most 1e-12 of the largest
eigenvalue) has a null ``whitened`` value and is left out of ``identity_error``; ``explained`` is
null where nothing varies.  ``deviation`` is null where it passes 64 bits, with the exact value in
``deviation_digits`` (text).  Equal eigenvalues leave the choice of their vectors to ``eigh``.  An
empty table gives no rows; columns that are not named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Bits of a limb of a sum on its way through Spark, and of one inside a task.
LIMB, PART = 60, 21
#: Numbers a task holds at once: rows times dimensions.
HELD = 2**20
#: Rows of an Arrow batch while whitened rows are written.
ROWS = 2000
#: Share of the largest eigenvalue from which a component counts as varying.
LEAST = 1e-12

LONG = 2**63


def integers(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT):
    """(vec_id, x) of the vectors that take part."""
    c = F.transform(vector, lambda v: v.cast("double"))
    scaled = F.transform("c", lambda v: F.floor(v * F.lit(float(scale))) + F.lit(shift))
    fits = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * float(scale)) < float(LONG - 2**40)))
    sound = vectors.select(F.col(id).alias("vec_id"), c.alias("c")).filter(
        F.col("c").isNotNull() & (F.size("c") > 0) & F.coalesce(fits, F.lit(False))
    )
    lengths = sound.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    top = lengths.orderBy(F.desc("rows"), F.desc("d")).limit(1).collect()
    dims = top[0]["d"] if top else 0
    return sound.filter(F.size("c") == dims).select("vec_id", scaled.alias("x")), dims


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in slices of a bounded number of entries, with the entries as a matrix."""
    rows = max(1, HELD // max(1, dims))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, np.asarray(part.column("x").flatten(), np.int64).reshape(-1, dims)


def _bound(m: np.ndarray) -> int:
    return max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0))))


def column_sums(m: np.ndarray) -> list[int]:
    """Exact sums of the columns of whole numbers."""
    if m.dtype == object or _bound(m) * len(m) < LONG:
        return [int(v) for v in m.sum(axis=0)]
    high, low = (m >> 32).sum(axis=0), (m & (2**32 - 1)).sum(axis=0)
    return [(int(h) << 32) + int(v) for h, v in zip(high, low, strict=True)]


def square_sums(m: np.ndarray) -> list[int]:
    """Exact sums of the squares of the columns: products of limbs of ``PART`` bits, each in 64 bits."""
    if m.dtype == object or _bound(m) ** 2 * len(m) < LONG:
        return [int(v) for v in (m * m).sum(axis=0)]
    limbs, rest = [], m
    while _bound(rest) >= 2**PART:
        limbs.append(rest & (2**PART - 1))
        rest = rest >> PART
    limbs.append(rest)
    total = [0] * m.shape[1]
    for i, a in enumerate(limbs):
        for j in range(i, len(limbs)):
            sums = (a * limbs[j]).sum(axis=0)
            for k, v in enumerate(sums):
                total[k] += (1 if i == j else 2) * int(v) << PART * (i + j)
    return total


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in 64 bits where these hold twice the value, else in Python's numbers."""
    if n * _bound(x) < LONG // 4 and max(map(abs, sums), default=0) < LONG // 4:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _limbs(key: int, value: int) -> Iterator[tuple[int, int, int]]:
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield key, k, sign * (value & (2**LIMB - 1))
        value >>= LIMB
        k += 1


def _added(parts: DataFrame) -> dict[int, int]:
    """Sums per key from rows (key, limb, value)."""
    rows = parts.groupBy("key", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    total: dict[int, int] = {}
    for r in rows.collect():
        total[r["key"]] = total.get(r["key"], 0) + (int(r["value"]) << LIMB * r["limb"])
    return total


def _sent(total: dict[int, int]) -> pa.RecordBatch:
    rows = [x for key, value in total.items() for x in _limbs(key, value)]
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    types = (pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "limb", "value"]
    )


PARTIAL = "key bigint, limb int, value bigint"


@dataclass
class Fit:
    """What a whitening needs: rows, exact sums, falling eigenvalues and unit vectors in columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        return self.values > LEAST * max(float(self.values[0]), 0.0) if len(self.values) else np.zeros(0, bool)


def sums(x: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for part, m in _blocks(batches, dims):
            total[-1] = total.get(-1, 0) + part.num_rows
            for i, v in enumerate(column_sums(m)):
                total[i] = total.get(i, 0) + v
        yield _sent(total)

    found = _added(x.mapInArrow(run, PARTIAL))
    return found.get(-1, 0), [found.get(i, 0) for i in range(dims)]


def squares(x: DataFrame, n: int, sums: list[int]) -> dict[int, int]:
    """Sums of (y_i + y_j)^2 under key i * d + j for i < j, and of y_i^2 under i * d + i."""
    dims = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for _, m in _blocks(batches, dims):
            y = centred(m, n, sums)
            for i in range(dims):
                pairs = y[:, i:] + y[:, i : i + 1]
                pairs[:, 0] = y[:, i]
                for j, v in enumerate(square_sums(pairs), i):
                    total[i * dims + j] = total.get(i * dims + j, 0) + v
        yield _sent(total)

    return _added(x.mapInArrow(run, PARTIAL))


def covariance(squared: dict[int, int], n: int, dims: int) -> np.ndarray:
    """Covariances with divisor n, each rounded once."""
    v = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            own = squared.get(i * dims + j, 0)
            twice = 2 * own if i == j else own - squared.get(i * dims + i, 0) - squared.get(j * dims + j, 0)
            v[i, j] = v[j, i] = twice / (2 * n**3)
    return v


def fit(x: DataFrame, dims: int) -> Fit:
    """The whitening of all rows of ``integers``."""
    n, total = sums(x, dims)
    if not n:
        return Fit(0, total, np.zeros(0), np.zeros((dims, 0)), 0.0)
    v = covariance(squares(x, n, total), n, dims)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(dims)] < 0, -1.0, 1.0)
    return Fit(n, total, values, vectors, float(np.trace(v)))


WHITE = "vec_id {}, deviation bigint, deviation_digits string, white array<double>"


def transformed(x: DataFrame, f: Fit, components: int = COMPONENTS) -> DataFrame:
    """One row per vector: its exact deviation and its whitened components."""
    dims, live = len(f.sums), f.live[:components]
    scales = np.where(live, 1 / np.sqrt(np.where(live, f.values[:components], 1.0)), np.nan)
    basis = f.vectors[:, :components]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m in _blocks(batches, dims):
            y = centred(m, f.n, f.sums)
            deviations = [sum(int(v) ** 2 for v in row) for row in y.tolist()] if y.dtype == object else None
            if deviations is None:
                deviations = square_sums(np.ascontiguousarray(y.T))
            white = (y / f.n).astype(float) @ basis * scales
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id"),
                    pa.array([v if v < LONG else None for v in deviations], pa.int64()),
                    pa.array([str(v) for v in deviations], pa.string()),
                    pa.array([[None if np.isnan(v) else v for v in row] for row in white.tolist()], pa.list_(pa.float64())),
                ],
                ["vec_id", "deviation", "deviation_digits", "white"],
            )

    return x.mapInArrow(run, WHITE.format(x.schema["vec_id"].dataType.simpleString()))


def identity_error(white: DataFrame, live: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened rows minus the identity.

    ``covar_pop`` centres as it goes.
    """
    if not live:
        return None
    pairs = [(i, j) for i in range(live) for j in range(i, live)]
    row = white.agg(*[F.covar_pop(F.col("white")[i], F.col("white")[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()[0]
    if row[0] is None:
        return None
    return max(abs(row[k] - (i == j)) for k, (i, j) in enumerate(pairs))


def whitened(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
    scale: int = SCALE, shift: int = SHIFT,
) -> DataFrame:
    """One row per vector and component; see the module for the columns."""
    ship(vectors.sparkSession)
    x, dims = integers(vectors, id, vector, scale, shift)
    f = fit(x, dims)
    white = stored(transformed(x, f, components), "whitened", ROWS)
    kept = min(components, dims)
    live = int(f.live[:kept].sum())
    error = identity_error(white, live)
    shares = [float(v) / f.trace if f.trace > 0 else None for v in f.values[:kept]]
    explained = F.array(*[F.lit(v).cast("double") for v in shares]) if shares else F.array().cast("array<double>")
    return white.select(
        "vec_id",
        F.posexplode("white").alias("k", "whitened"),
        "deviation",
        "deviation_digits",
        F.lit(f.n).cast("bigint").alias("n"),
        F.lit(error).cast("double").alias("identity_error"),
        explained.alias("shares"),
    ).select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get("shares", F.col("k")).alias("explained"),
        "identity_error",
        "deviation_digits",
    )
