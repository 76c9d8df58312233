"""Tensor columns: flat row-major arrays whose shape is kept in the field's metadata."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = "tensor_shape"


def tensor_array(values: np.ndarray) -> pa.Array:
    """One tensor per row, from an array of two dimensions or more."""
    if values.ndim < 2:
        raise ValueError(f"tensor_array needs (rows, ...), not {values.ndim} dimension(s)")
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(values))


def tensor_from_rows(rows: Sequence[np.ndarray]) -> pa.Array:
    """As `tensor_array`, from tensors of one shape and type."""
    if not rows or len({(r.shape, r.dtype) for r in rows}) != 1:
        raise ValueError("tensors need one shape and one type, and at least one row")
    return tensor_array(np.stack(rows))


def embedding_array(vectors: np.ndarray) -> pa.Array:
    """(rows, dimension) as float32 tensors."""
    if vectors.ndim != 2:
        raise ValueError(f"embedding_array needs two dimensions, not {vectors.ndim}")
    return tensor_array(vectors.astype(np.float32))


def to_numpy(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, ...) of a tensor column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if not isinstance(column.type, pa.FixedShapeTensorType):
        raise TypeError(f"not a tensor column: {column.type}")
    return column.to_numpy_ndarray()


def with_shape(column: Column, name: str, shape: Sequence[int]) -> Column:
    """Name a flat array column and attach its tensors' shape."""
    return column.alias(name, metadata={SHAPE: list(shape)})


def shape_of(df: DataFrame, column: str) -> tuple[int, ...]:
    metadata = df.schema[column].metadata or {}
    if SHAPE not in metadata:
        raise TypeError(f"column {column!r} has no tensor shape")
    return tuple(metadata[SHAPE])


def reattach(df: DataFrame, column: str, shape: Sequence[int]) -> DataFrame:
    """Put a shape back that an aggregate or a higher-order function dropped."""
    return df.withColumn(column, with_shape(F.col(f"`{column}`"), column, shape))


def batch_to_numpy(batch: pa.RecordBatch, column: str, shape: Sequence[int]) -> np.ndarray:
    """(rows, *shape) of a flat array column in an Arrow batch, without a copy where it has no nulls."""
    array = batch.column(column)
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), *shape)
