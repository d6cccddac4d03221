"""Vectors of numbers as they lie in a table: which rows count, and their fixed-point components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed-point components stay below this, so that they and their sum with an offset are longs.
LARGEST = float(2**62)


def usable(column: pa.Array) -> np.ndarray:
    """Whether each vector is there and all of its entries are there and finite.  An empty vector counts."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    finite = np.isfinite(column.flatten().to_numpy(zero_copy_only=False).astype(float))  # a null entry reads as NaN
    bad = np.bincount(np.repeat(np.arange(len(column)), lengths), ~finite, minlength=len(column))
    return (bad == 0) & pc.is_valid(column).to_numpy(zero_copy_only=False)


def fixed_point(column: pa.Array, width: int = 0, scale: float = 1024.0) -> np.ndarray:
    """floor(scale * c) of usable vectors as doubles (whole numbers), one row each.

    Rows have the longest vector's length, or ``width`` if that is more: a shorter vector has zeros beyond its end.  Entries beyond 2**62 stop there.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    width = max([width, *lengths.tolist()])
    values = np.clip(np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(float)), -LARGEST, LARGEST)
    if (lengths == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out
