"""Arrow list columns as NumPy matrices and back, without a loop over rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def as_matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as the rows of a matrix of doubles."""
    if column.null_count:
        raise ValueError("a vector is null")
    widths = np.diff(column.offsets.to_numpy())
    if len(widths) and (widths != widths[0]).any():
        raise ValueError("vectors differ in length")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def as_lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))
