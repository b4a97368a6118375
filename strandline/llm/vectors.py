"""Integer vectors for the vector operators: which rows count, and how their components become integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

#: Components beyond this are taken as this, so that every sum of products fits 64 bits (up to 4096 components).
MOST = 4096.0


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    most = F.lit(MOST)
    return F.transform(vector, lambda v: F.floor(F.least(F.greatest(v.cast("double"), -most), most) * F.lit(float(scale))).cast("int"))


def quantised(rows: DataFrame, scale: int, vector: str = "embedding", **more: Column) -> DataFrame:
    """The columns `more` and q, the integer vector, of the usable rows; no other column is read."""
    return rows.where(usable(col(vector))).select(*[c.alias(n) for n, c in more.items()], integers(col(vector), scale).alias("q"))


def width_of(kept: DataFrame) -> int:
    """Components of the longest vector; shorter ones are filled with zeros."""
    return kept.agg(F.max(F.size("q"))).first()[0] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as int64 rows of `width` components."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(values)) - starts[at]] = values
    return out


def listed(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A 2-d array as a list column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel(), kind))
