"""In-memory sources: Arrow tables and batches as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.tensors import SHAPE

#: Spark has no unsigned types: each widens to the next signed one.
_WIDER = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}


def _plain(kind: pa.DataType) -> pa.DataType:
    if isinstance(kind, pa.FixedShapeTensorType):
        return pa.list_(_plain(kind.value_type))
    if pa.types.is_dictionary(kind):
        return _plain(kind.value_type)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        return pa.list_(_plain(kind.value_type))
    return _WIDER.get(kind, kind)


def _column(column: pa.ChunkedArray) -> pa.ChunkedArray:
    chunks = [c.storage if isinstance(c, pa.ExtensionArray) else c for c in column.chunks]
    kind = _plain(column.type)
    if not chunks:
        return pa.chunked_array([], kind)
    return pa.chunked_array([c if c.type == kind else c.cast(kind) for c in chunks])


def from_table(spark: SparkSession, table: pa.Table) -> DataFrame:
    """Unsigned types widen, dictionaries decode, tensors become flat arrays with their shape in the metadata."""
    plain = pa.table({name: _column(table.column(name)) for name in table.column_names})
    df = spark.createDataFrame(plain)
    for field in table.schema:
        if isinstance(field.type, pa.FixedShapeTensorType):
            df = df.withMetadata(field.name, {SHAPE: list(field.type.shape)})
    return df


def from_batches(spark: SparkSession, *batches: pa.RecordBatch | pa.Table) -> DataFrame:
    """All batches as one frame; their schemas must agree."""
    tables = []
    for batch in batches:
        if not isinstance(batch, (pa.RecordBatch, pa.Table)):
            raise TypeError(f"from_batches takes Arrow batches, not {type(batch).__name__}")
        tables.append(batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch]))
    if not tables:
        raise ValueError("from_batches needs at least one batch")
    return from_table(spark, pa.concat_tables(tables))


def from_pydict(spark: SparkSession, **columns: Sequence) -> DataFrame:
    return from_table(spark, pa.table(columns))


def empty_like(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))
