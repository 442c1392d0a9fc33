"""What the vector operators share: which rows take part, and Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(embedding: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    inf = float("inf")
    return F.coalesce(F.forall(embedding.cast("array<double>"), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < inf)), F.lit(False))


def of_usual_length(vectors: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """``columns`` and ``v ARRAY<DOUBLE>`` of the rows with a finite vector, and its length.

    Vectors of different lengths share no space: those of the most frequent length stay (the
    longer one if two are as frequent), empty vectors never.  Without rows the length is 0.
    """
    kept = vectors.where(finite(F.col("embedding")) & (F.size("embedding") > 0))
    usual = kept.groupBy(F.size("embedding").alias("width")).count().agg(F.max(F.struct("count", "width")).alias("most")).first().most
    width = usual.width if usual else 0
    kept = kept.where(F.size("embedding") == width)
    return kept.select(*columns, F.col("embedding").cast("array<double>").alias("v")), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow batch, all ``width`` long, one per row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``, exact: 64-bit integers, or Python's where squares of differences of a row could pass 2^62."""
    largest = float(np.abs(x).max(initial=0.0)) * scale
    if 2 * largest + 2 < ((1 << 62) / max(1, x.shape[1])) ** 0.5:
        return np.floor(x * scale).astype(np.int64)
    exact = [[int(c * scale // 1) if abs(c) < 1e290 else int(c) * scale for c in row] for row in x.tolist()]
    return np.array(exact, object).reshape(x.shape)
