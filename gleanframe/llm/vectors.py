"""Vectors as integers: what the clustering operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest component by absolute value, after scaling: squared distances of 64 such differences fit a long.
LARGEST = 1 << 27


def scaled(vectors: DataFrame, column: str, scale: int, dims: int, *keep: Column) -> DataFrame:
    """keep..., x: floor(scale * component) as array<int>, of vectors with exactly dims components, none of them null or
    not finite. A component beyond LARGEST is an error: no exact distance is a long there."""
    v = F.transform(F.col(f"`{column}`"), lambda c: c.cast("double"))
    rows = vectors.select(*keep, v.alias("_v")).where((F.size("_v") == dims) & F.forall("_v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    far = F.lit("a component is too large for exact squared distances")
    whole = F.transform("_v", lambda c: F.when(F.abs(c) * scale < LARGEST, F.floor(c * scale)).otherwise(F.raise_error(far)).cast("int"))
    return rows.select(*[c for c in rows.columns if c != "_v"], whole.alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix as a list column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def mean_floor(sums: list[int], count: int) -> list[int]:
    """Componentwise floor of the exact mean."""
    return [s // count for s in sums]
