"""Vectors in fixed point: what clustering and code compression share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components of this size and more are refused: sums of 64 of their squares would leave a long.
LIMIT = 1 << 27


def in_fixed_point(vectors: DataFrame, scale: int, *columns: str, vector: str = "embedding") -> DataFrame:
    """The columns and x, array<int>: floor(scale * component) of every vector without null or non-finite components.

    Null vectors are dropped, empty ones kept. Scaled components of LIMIT and more are an error.
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    checked: Column = F.transform(v, lambda c: F.when(F.abs(c * scale) < LIMIT, F.floor(c * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is {LIMIT} or more")).cast("int")))
    return vectors.where(finite).select(*columns, checked.alias("x"))


def rows_of(column: pa.ListArray, n: int) -> np.ndarray:
    """A column of lists of one length as a matrix of n rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def lists_of(matrix: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(ends, np.ascontiguousarray(matrix).reshape(-1))


def joined(values: np.ndarray) -> str:
    return ",".join(map(str, values.reshape(-1).tolist()))
