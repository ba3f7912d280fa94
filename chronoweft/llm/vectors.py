"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null or empty, only finite components, one that isn't zero."""
    d = lambda x: x.cast("double")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(d(x)) & (F.abs(d(x)) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usual_size(rows: DataFrame, v: str) -> int:
    """The most common length of the vectors (the smallest such); 0 for an empty table."""
    got = rows.groupBy(F.size(v).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return got["n"] if got else 0


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column."""
    offsets = pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(m.ravel()).cast(kind))
