"""Integer vectors from float vectors, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

EXACT = float(1 << 53)  # integers below this are exact as doubles


def scaled(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as a long; beyond the long range its end."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is there and holds numbers only: no null, NaN or infinity."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return df.filter(F.col(vector).isNotNull() & finite)


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """The lists of longs as rows of one matrix, shorter ones padded by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == len(sizes) * dims and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def largest(x: np.ndarray) -> float:
    """The largest magnitude; no entries have 0."""
    return float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of x with those of y; past the long range its ends."""
    if x.shape[1] * largest(x) * largest(y) < EXACT:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    whole = x.astype(object) @ y.astype(object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)
