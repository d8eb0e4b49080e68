"""Small numpy helpers that tasks use on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from marginspark.params import MarginParams


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a dense matrix; every row must have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if rows == 0:
        return np.zeros((0, 0))
    if column.null_count or len(flat) % rows:
        raise ValueError("vectors must be non-null and of equal length")
    ends = np.diff(column.offsets.to_numpy())
    if not (ends == ends[0]).all():
        raise ValueError("vectors must be non-null and of equal length")
    return flat.reshape(rows, -1)


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(
        column, pa.Array
    ) else column.to_numpy()


def vectors(rows: np.ndarray) -> pa.Array:
    """A dense matrix as an ``array<double>`` column."""
    rows = np.ascontiguousarray(rows, dtype=np.float64)
    offsets = np.arange(rows.shape[0] + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def slope(s: np.ndarray, p: MarginParams, m: float = 1.0) -> np.ndarray:
    """Derivative of the row loss by the margin (see ``margin.loss_slope``)."""
    c = 2.0 * p.loss_weight(m)
    return c * np.where(s < p.low, s - p.low, 0.0) + c * p.mu * np.where(
        s > p.high, s - p.high, 0.0
    )


def nearest(X: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest center; exact ties go to
    the lowest index.  The products find the candidates, and rows with more
    than one candidate within rounding are settled by the difference form."""
    c2 = np.einsum("ij,ij->i", centers, centers)
    # the row's own square is the same for all centers
    rank = X @ centers.T
    rank *= -2.0
    rank += c2
    best = rank.argmin(axis=1)
    slack = 1e-9 * (1.0 + np.einsum("ij,ij->i", X, X) + c2.max())
    limit = rank[np.arange(len(X)), best] + slack
    close = rank <= limit[:, None]
    ties = np.flatnonzero(close.sum(axis=1) > 1)
    if len(ties):
        rows = X[ties]
        exact = np.stack([((rows - c) ** 2).sum(axis=1) for c in centers], axis=1)
        best[ties] = exact.argmin(axis=1)
    chosen = X - centers[best]
    return best, np.einsum("ij,ij->i", chosen, chosen)


def partial_sum(batches: Iterable[pa.RecordBatch], add) -> Iterator[pa.RecordBatch]:
    """Fold a task's batches into one vector, the map side of a vector sum."""
    total = None
    for batch in batches:
        if batch.num_rows:
            part = add(batch)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([vectors(total[None, :])], ["v"])
