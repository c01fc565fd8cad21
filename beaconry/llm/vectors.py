"""Vectors of a column in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) by dimension, of the vectors without null or non-finite components."""
    flat = column.flatten() if column.null_count else column.values.slice(
        column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py())
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    sizes = np.asarray(pc.list_value_length(column).drop_null(), dtype=np.int64)
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes) - sizes
    out = []
    for d in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == d)
        x = values[at[some][:, None] + np.arange(d)[None, :]] if d else np.zeros((len(some), 0))
        good = np.isfinite(x).all(axis=1)
        out.append((rows[some][good], x[good]))
    return out


def raw(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(x, dtype=np.float64)]


def stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The matrix of equally long vectors of ``raw`` bytes."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def sampled(keys, seed: int = 42) -> F.Column:
    """The order in which a bounded sample is taken: a hash of the id."""
    return F.xxhash64(F.lit(seed), keys)
