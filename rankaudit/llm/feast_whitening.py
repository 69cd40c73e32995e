"""Whitening of vectors by their leading principal components, found by contour integration.

Sums and products of the fit list are exact integers: entries become whole numbers, are shifted by a whole number near
their mean, and products of what is left are added up over the whole table in decimals, so neither the order of rows nor
a repeated task can change a bit. The covariance, one number per pair of dimensions, is the only thing that reaches the
driver; its size depends on the dimensions alone.

There the leading eigenvalues are bracketed by inertia counts: the signs of the pivots of a symmetric factorisation of
V - sI tell how many eigenvalues lie above s. For each interval the projector is applied to a random block by
Gauss-Legendre quadrature of the resolvent along a circle around it, one complex shifted solve a node. Rayleigh-Ritz on
the projected block gives the components of the interval, and the step is repeated until their residuals are down to
rounding. An interval is finished only with as many components as its inertia count says, so none is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Eigenvalues of one interval at most, where their gaps allow; quadrature nodes of the upper half circle; steps.
SLICE, NODES, STEPS = 8, 12, 40
#: Entries are kept inside this bound, far outside what integers of doubles tell apart.
BOUND = 1 << 60
_EXACT = T.DecimalType(38, 0)
_SAFE = 2.0**62


# ---- exact statistics of the fit list ---------------------------------------------------


def whole_entries(vector: Column) -> Column:
    """floor(1024 c) + 100000 of every entry as a long, where all entries are finite; else null."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    scaled = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE).cast("double"), F.lit(float(BOUND))), F.lit(-float(BOUND)))
    return F.when(~bad, F.transform(vector, lambda c: scaled(c).cast("bigint") + OFFSET))


def fit_list(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Ids and whole entries `x` of the vectors without null or non-finite entries."""
    return vectors.select(F.col(id_col).alias("id"), whole_entries(F.col(vector_col)).alias("x")).where("x is not null")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(values: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    if values.size and float(np.abs(values).max()) * len(values) >= _SAFE:
        values = values.astype(object)
    return [int(v) for v in values.sum(axis=0)]


def _products(y: np.ndarray) -> np.ndarray:
    """Exact products of all pairs of columns."""
    most = float(np.abs(y).max()) if y.size else 0.0
    if most * most * len(y) < 2.0**53:
        wide = y.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    own = y.astype(object) if most * most * len(y) >= _SAFE else y
    return (own.T @ own).astype(object)


def _exact_sums(x: DataFrame, dims: int, key: str, work) -> dict:
    """Sums over the table of what `work` makes of every batch: an object array by key."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("value", _EXACT)])
    arrow = arrow_schema(schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = work(_matrix(batch.column("x"), dims))
                total = own if total is None else total + own
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int64()), pa.array([Decimal(int(v)) for v in flat], arrow.field("value").type)], schema=arrow)

    rows = x.select("x").mapInArrow(partial, schema).groupBy(key).agg(F.sum("value").cast(_EXACT).alias("value")).collect()
    return {r[key]: int(r["value"]) for r in rows}


@dataclass(frozen=True)
class Statistics:
    """Count, sums of every dimension and the covariance (divisor n) of the fit list."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    trace: float


def statistics(x: DataFrame, dims: int) -> Statistics:
    """Two passes: sums, then products around whole numbers near the means; n² V is an exact integer, rounded once."""
    first = _exact_sums(x, dims, "place", lambda m: np.array([len(m), *_summed(m)], object))
    n, sums = first.get(0, 0), [first.get(i + 1, 0) for i in range(dims)]
    if not n:
        return Statistics(0, sums, np.zeros((dims, dims)), 0.0)
    shift = [(2 * s + n) // (2 * n) for s in sums]
    around = np.array(shift, np.int64)
    upper = np.triu_indices(dims)
    products = _exact_sums(x, dims, "pair", lambda m: _products(m - around)[upper])
    rest = [s - n * m for s, m in zip(sums, shift)]
    covariance, trace = np.zeros((dims, dims)), 0
    for k, (i, j) in enumerate(zip(*upper)):
        whole = n * products[k] - rest[i] * rest[j]
        covariance[i, j] = covariance[j, i] = whole / (n * n)
        trace += whole if i == j else 0
    return Statistics(n, sums, covariance, trace / (n * n))


# ---- eigenvalues in intervals -----------------------------------------------------------


def count_above(v: np.ndarray, s: float) -> int:
    """Eigenvalues of the symmetric matrix above `s`: positive pivots of V - sI, factorised with pivots of order one and two."""
    a, positive = v - s * np.eye(len(v)), 0
    turn = (1 + math.sqrt(17)) / 8
    while len(a):
        diagonal, far = np.abs(np.diag(a)), np.abs(a - np.diag(np.diag(a)))
        r, (p, q) = int(diagonal.argmax()), np.unravel_index(far.argmax(), far.shape)
        if diagonal[r] >= turn * far[p, q]:
            if a[r, r] == 0:
                break
            positive += bool(a[r, r] > 0)
            rest = np.delete(np.arange(len(a)), r)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, r], a[rest, r]) / a[r, r]
        else:
            positive += 1  # a pivot of order two has one eigenvalue of each sign
            rest = np.delete(np.arange(len(a)), [p, q])
            pair, block = a[np.ix_([p, q], [p, q])], a[np.ix_(rest, [p, q])]
            a = a[np.ix_(rest, rest)] - block @ np.linalg.solve(pair, block.T)
        a = (a + a.T) / 2
    return positive


def _cut(v: np.ndarray, low: float, high: float, wanted: int) -> tuple[float, int]:
    """A place in (low, high) with as few eigenvalues above it as can be, but `wanted` at least, by bisection on inertia counts.

    It is moved into the gap below the last of them: halfway to the next eigenvalue, as far as the counts tell it.
    """
    a, b = low, high  # the count at a is wanted or more, at b less
    while b - a > 1e-12 * max(abs(a), abs(b)) and (count_above(v, a) > wanted or b - a > 1e-3 * (high - low)):
        middle = (a + b) / 2
        if count_above(v, middle) >= wanted:
            a = middle
        else:
            b = middle
    count, down, step = count_above(v, a), a, (b - a) or abs(a) * 1e-12
    while a - step > low and count_above(v, a - step) == count:
        down, step = a - step, step * 2
    lowest, end = max(low, a - step), down
    for _ in range(8):
        middle = (lowest + end) / 2
        if count_above(v, middle) == count:
            end = middle
        else:
            lowest = middle
    return (end + a) / 2, count


def rounding(v: np.ndarray) -> float:
    """Eigenvalues up to this size are zero as far as doubles tell."""
    return len(v) * np.finfo(float).eps * float(np.abs(v).sum(axis=1).max())


def _top(v: np.ndarray, above: int, low: float, high: float) -> float:
    """A place at most a hundredth over the greatest eigenvalue below `high`, which has `above` eigenvalues over it."""
    while high - low > 0.01 * high:
        middle = (low + high) / 2
        if count_above(v, middle) > above:
            low = middle
        else:
            high = middle
    return high


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals from the greatest eigenvalue down, each with its inertia count, that hold `wanted` positive eigenvalues or more, or all.

    An interval reaches down to about a quarter of its greatest eigenvalue, so none is at the rim of a circle far wider than itself.
    """
    low, high = rounding(v), float(np.abs(v).sum(axis=1).max()) * 1.01
    wanted, found, above = min(wanted, count_above(v, low)), [], 0
    while above < wanted:
        top = _top(v, above, low, high)
        near = max(above + 1, count_above(v, max(low, top / 4)))
        cut, count = _cut(v, low, top, min(wanted, above + SLICE, near))
        found.append((cut, min(high, 1.25 * top), count - above))
        above, high = count, cut
    return found


def filtered(v: np.ndarray, block: np.ndarray, low: float, high: float, nodes: int = NODES) -> np.ndarray:
    """The projector of the interval on the block: quadrature of the resolvent over the circle on (low, high)."""
    at, weight = np.polynomial.legendre.leggauss(nodes)
    centre, radius, eye = (low + high) / 2, (high - low) / 2, np.eye(len(v))
    total = np.zeros_like(block)
    for x, w in zip(at, weight):
        turn = np.exp(1j * np.pi / 2 * (1 - x))
        solved = np.linalg.solve((centre + radius * turn) * eye - v, block.astype(complex))
        total += w / 2 * (radius * turn * solved).real
    return total


def eigenpairs(v: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenvalues in (low, high), falling, and their unit vectors as columns."""
    dims, size, scale = len(v), min(len(v), count + max(4, count // 2)), float(np.abs(v).max())
    inside = (np.empty(0), np.empty((dims, 0)))
    while True:
        block = np.random.default_rng(seed).standard_normal((dims, size))
        best = math.inf
        for _ in range(STEPS):
            basis, _ = np.linalg.qr(filtered(v, np.linalg.qr(block)[0], low, high))
            values, turned = np.linalg.eigh(basis.T @ v @ basis)
            vectors = basis @ turned
            within = (values > low) & (values < high)
            residual = np.linalg.norm(v @ vectors[:, within] - vectors[:, within] * values[within], axis=0).max(initial=0.0)
            if int(within.sum()) == count:
                inside = (values[within][::-1], vectors[:, within][:, ::-1])
                if residual <= 4 * np.finfo(float).eps * scale or residual >= best / 2 and residual <= 64 * dims * np.finfo(float).eps * scale:
                    return inside
                best = min(best, residual)
            block = vectors
        if size == dims:
            raise ArithmeticError(f"{count} eigenvalues counted in ({low}, {high}), {len(inside[0])} found")
        size = min(dims, 2 * size)


def leading_components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` greatest eigenvalues and their unit vectors as columns; values of zero, up to rounding, are left out."""
    if not len(v) or not np.abs(v).max() > 0:
        return np.empty(0), np.empty((len(v), 0))
    found = [eigenpairs(v, low, high, count) for low, high, count in intervals(v, wanted)]
    if not found:
        return np.empty(0), np.empty((len(v), 0))
    values, vectors = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found], axis=1)
    # Over the intervals together once more, so that vectors of neighbouring intervals are at right angles to rounding.
    basis, _ = np.linalg.qr(vectors)
    values, turned = np.linalg.eigh(basis.T @ v @ basis)
    values, vectors = values[::-1][:wanted], (basis @ turned)[:, ::-1][:, :wanted]
    return values, vectors / np.linalg.norm(vectors, axis=0)


# ---- whitening --------------------------------------------------------------------------


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum over the dimensions of (n x - S)²."""
    most = n * float(np.abs(x).max(initial=0)) + float(max(map(abs, sums), default=0))
    if most >= _SAFE:
        scaled = n * x.astype(object) - np.array(sums, object)
    else:
        scaled = n * x - np.array(sums, np.int64)
        if float(np.abs(scaled).max(initial=0)) ** 2 * x.shape[1] >= _SAFE:
            scaled = scaled.astype(object)
    return [int(d) for d in (scaled * scaled).sum(axis=1)]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out, of the fit too. So are vectors without
    entries, and those whose length is not the most frequent one (the greatest of several), which have no place in a
    common covariance. Repeated rows and ids, null ids too, are separate rows. Components are numbered by falling
    eigenvalue; those with eigenvalue zero have nothing to be scaled by and are left out, so a table of equal vectors,
    like an empty one, gives no rows. Entries beyond 2^60 in size after scaling count as 2^60. `deviation` is a decimal
    of 38 digits, null where it has more. Other columns are ignored, whatever their names.
    """
    id_type = vectors.schema[id_col].dataType
    x = fit_list(vectors, id_col, vector_col)
    size = x.groupBy(F.size("x").alias("dims")).count().where("dims > 0").orderBy(F.desc("count"), F.desc("dims")).first()
    dims = size["dims"] if size else 0
    x = x.where(F.size("x") == dims)
    known = statistics(x, dims) if dims else Statistics(0, [], np.zeros((0, 0)), 0.0)
    values, axes = leading_components(known.covariance, components)
    scaled = axes / np.sqrt(values)
    error = float(np.abs(scaled.T @ known.covariance @ scaled - np.eye(len(values))).max(initial=0.0))
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", _EXACT),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    arrow, count = arrow_schema(schema), len(values)
    n, sums, share = known.n, known.sums, values / known.trace if count else values
    mean = np.array([s / n for s in sums]) if n else np.zeros(dims)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (batch.num_rows and count):
                continue
            own = _matrix(batch.column("x"), dims)
            far = [Decimal(d) if d < 10**38 else None for d in _deviations(own, n, sums)]
            every = pa.array(np.repeat(np.arange(len(own)), count))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(every).cast(arrow.field(id_col).type), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(own))),
                pa.repeat(pa.scalar(n, pa.int64()), len(every)), pa.array(far, arrow.field("deviation").type).take(every), pa.array(((own - mean) @ scaled).ravel()),
                pa.array(np.tile(share, len(own))), pa.repeat(pa.scalar(error, pa.float64()), len(every)),
            ], schema=arrow)

    return x.mapInArrow(project, schema)
