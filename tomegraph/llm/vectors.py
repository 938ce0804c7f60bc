"""Vectors of an Arrow list column as padded numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def finite_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the vectors that are not null and hold neither nulls nor non-finite entries, their matrix (double) and widths.

    Shorter vectors are filled with zeros on the right.
    """
    if len(column) == 0:
        return np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0, np.int64)
    offsets = column.offsets.to_numpy().astype(np.int64)
    base = offsets[0]
    flat = column.values.slice(base, offsets[-1] - base)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    offsets = offsets - base
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = np.flatnonzero((wrong[offsets[1:]] == wrong[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False))
    width = offsets[good + 1] - offsets[good]
    out = np.zeros((len(good), int(width.max()) if len(good) else 0))
    inside = np.arange(out.shape[1]) < width[:, None]
    out[inside] = values[(offsets[good][:, None] + np.arange(out.shape[1]))[inside]]
    return good, out, width


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
