"""Tables of vectors: which rows take part, and their components as matrices of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str | Column) -> Column:
    """The vector isn't null and has no null or non-finite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrices(column: pa.Array, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length among the vectors: their positions, and floor(scale * component) as doubles, a row a vector."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
    start = np.cumsum(length) - length
    out = []
    for d in np.unique(length).tolist():
        at = np.flatnonzero(length == d)
        out.append((at, flat[start[at][:, None] + np.arange(d)]))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact; those beyond a long are its ends."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a).dot(whole(b).T) if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)
