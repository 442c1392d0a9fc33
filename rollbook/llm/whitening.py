"""Whitening of embeddings on their leading components, found by spectrum slicing.

Sums and covariances are partial sums of tasks.  On the driver stays a matrix of the vector's length:
it is brought to tridiagonal form, whose LDL^T factors, shifted by s, have as many positive pivots as there are
eigenvalues above s.  Halving intervals by these counts isolates each leading eigenvalue; Rayleigh quotient iteration
on the full matrix then converges cubically to its vector, and the counts on both sides certify
that the value found is the one numbered so.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.vectors import matrix, of_usual_length
from rollbook.session import materialise

#: Components are multiplied by this and rounded down, and this is added.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Integers end here, far from what longs hold.
_END = float(1 << 62)
#: Components whose variance is a smaller share of the largest one's than this are rounding only.
LEAST_SHARE = 1e-12
_EPS = float(np.finfo(float).eps)


def integers(v: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(v * SCALE), -_END, _END).astype(np.int64) + OFFSET


# The spectrum of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[list[float], list[float]]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of ``a``, by reflections."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = float(np.linalg.norm(x))
        if norm == 0 or not x[1:].any():
            continue
        x[0] += norm if x[0] >= 0 else -norm
        x /= np.linalg.norm(x)
        below = a[k + 1 :, k + 1 :]
        p = below @ x
        w = 2 * (p - (x @ p) * x)
        below -= np.outer(x, w) + np.outer(w, x)
        column = a[k + 1 :, k] - 2 * x * (x @ a[k + 1 :, k])
        a[k + 1 :, k] = a[k, k + 1 :] = column
    return np.diag(a).tolist(), np.diag(a, 1).tolist()


def count_above(diagonal: list[float], off: list[float], shift: float, least: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of LDL^T, where a pivot below ``least`` counts as minus ``least``."""
    count, pivot, before = 0, 1.0, 0.0
    for d, o in zip(diagonal, [*off, 0.0], strict=True):
        pivot = d - shift - before * before / pivot
        if abs(pivot) < least:
            pivot = -least
        count += pivot > 0
        before = o
    return count


def _quotient_iteration(a: np.ndarray, vector: np.ndarray, shift: float, found: list[np.ndarray], size: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration, begun at ``shift``; ``found`` are vectors of the same cluster to stay away from."""
    eye, value = np.eye(len(a)), shift
    for step in range(50):
        try:
            solved = np.linalg.solve(a - value * eye, vector)
        except np.linalg.LinAlgError:
            solved = np.linalg.solve(a - (value + 4 * _EPS * size) * eye, vector)
        for f in found:
            solved -= (f @ solved) * f
        solved /= np.linalg.norm(solved)
        vector, before = solved, value
        # The first two steps keep the shift, so that the nearest eigenvalue wins.
        value = float(vector @ a @ vector) if step > 1 else shift
        if step > 2 and abs(value - before) <= 2 * _EPS * size and np.linalg.norm(a @ vector - value * vector) <= 64 * _EPS * size:
            break
    return value, vector


def leading(a: np.ndarray, k: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """The ``k`` largest eigenvalues of ``a``, falling, with unit vectors; those that are only rounding are left out.

    The largest entry of a vector is positive.  Equal eigenvalues get any vectors at right angles.
    """
    size = float(np.abs(a).sum(axis=1).max(initial=0.0))
    if size == 0:
        return []
    diagonal, off = tridiagonal(a)
    least = _EPS * _EPS * size
    above = lambda s: count_above(diagonal, off, s, least)
    slack = 16 * len(a) * _EPS * size
    found: list[tuple[float, np.ndarray]] = []
    for number in range(1, min(k, len(a)) + 1):
        low, high = -size * 1.01, size * 1.01  # number or more lie above low, fewer above high
        alone = False
        while high - low > slack / 4:
            middle = (low + high) / 2
            if above(middle) >= number:
                low = middle
            else:
                high = middle
            alone = above(low) - above(high) == 1
            if alone and high - low < 1e-3 * abs(high):
                break
        while True:
            near = [v for e, v in found if abs(e - (low + high) / 2) <= 8 * (high - low) + slack]
            start = np.cos(np.arange(1, len(a) + 1) * (1.0 + number))
            value, vector = _quotient_iteration(a, start, (low + high) / 2, near, size)
            if low - slack <= value <= high + slack or high - low <= slack / 4:
                break
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= number else (low, middle)
        if above(value + slack) >= number or above(value - slack) < number:
            raise ArithmeticError(f"eigenvalue {number} is not certified by the counts around {value}")
        if found and value < LEAST_SHARE * found[0][0] or value <= 0:
            break
        found.append((value, vector * np.sign(vector[np.abs(vector).argmax()])))
    return found


# Jobs


def _mean_sums(width: int):
    """Rows and sums per dimension of a task; sums in halves of 32 bits, so that none overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = integers(matrix(batch.column("v"), width))
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        at = np.arange(width)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(width, n)), pa.array(high), pa.array(low)], names=["at", "n", "high", "low"])

    return run


def _product_sums(width: int, mean: np.ndarray, axes: np.ndarray | None = None):
    """Sums of products of centred vectors (projected on ``axes``, if given), a row per pair of dimensions and task."""
    wide = width if axes is None else axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide, wide))
        for batch in batches:
            c = integers(matrix(batch.column("v"), width)).astype(float) - mean
            c = c if axes is None else c @ axes
            total += c.T @ c
        i, j = np.triu_indices(wide)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "s"])

    return run


def _covariance(rows: DataFrame, n: int, width: int, mean: np.ndarray, axes: np.ndarray | None = None) -> np.ndarray:
    """A matrix of ``width`` (or of the number of axes) squared comes to the driver."""
    parts = rows.select("v").mapInArrow(_product_sums(width, mean, axes), "i bigint, j bigint, s double")
    wide = width if axes is None else axes.shape[1]
    out = np.zeros((wide, wide))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.s / n
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """``sum((n * x - S)^2)`` of every row, exact; null beyond the largest long."""
    largest = int(np.abs(x).max(initial=0))
    reach = n * largest + max(map(abs, sums), default=0)
    if reach * reach * x.shape[1] < 1 << 62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    return [e if e < 1 << 63 else None for e in exact]


def _whitener(width: int, n: int, sums: list[int], mean: np.ndarray, axes: np.ndarray, explained: list[float], error: float):
    k = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(matrix(batch.column("v"), width))
            rows = len(x)
            columns = {
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * k, n)),
                "deviation": pa.array([d for d in deviations(x, n, sums) for _ in range(k)], pa.int64()),
                "whitened": pa.array(((x.astype(float) - mean) @ axes).ravel()),
                "explained": pa.array(np.tile(np.array(explained, float), rows)),
                "identity_error": pa.array(np.full(rows * k, error)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row of ``vectors``.

    Null vectors and those with a null or a component that is not finite are left out, as are empty ones and those
    of another length than most have; all other rows are the fit list, repeated and null ids too.  Components
    without variance (a share of ``LEAST_SHARE`` of the first one's) cannot be whitened and have no rows: there are
    fewer than ``components`` if vectors span fewer dimensions, and none for one row or equal rows.
    Integers end at 2^62; a ``deviation`` beyond the largest long is null.  An empty table gives no rows;
    further columns are ignored.
    """
    rows, width = of_usual_length(vectors, "vec_id")
    vec_id = rows.schema["vec_id"].dataType.simpleString()
    kind = f"vec_id {vec_id}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not width:
        return vectors.sparkSession.createDataFrame([], kind)
    rows = materialise(rows, "vectors")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = rows.select("v").mapInArrow(_mean_sums(width), "at bigint, n bigint, high bigint, low bigint")
    summed = {r.at: r for r in parts.groupBy("at").agg(F.sum("n").alias("n"), exact("high"), exact("low")).collect()}
    n, sums = int(summed[0].n), [(int(summed[d].high) << 32) + int(summed[d].low) for d in range(width)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    v = _covariance(rows, n, width, mean)
    found = leading(v, components)
    if not found:
        return vectors.sparkSession.createDataFrame([], kind)
    axes = np.stack([vector / np.sqrt(value) for value, vector in found], axis=1)
    explained = [value / float(np.trace(v)) for value, _ in found]
    error = float(np.abs(_covariance(rows, n, width, mean, axes) - np.eye(len(found))).max())
    return rows.mapInArrow(_whitener(width, n, sums, mean, axes, explained, error), kind)
