"""Authored sources as Spark data sources: one task per split, bounded or live."""

from __future__ import annotations

import inspect
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from rillworks.operators.arrow import _drive, _overlap
from rillworks.operators.author import LiveSource, OperatorContext, SourceOperator


def _batches(source: SourceOperator, split: object) -> Iterator[pa.RecordBatch]:
    made = source.batches(split)
    if inspect.isasyncgen(made):
        yield from _drive(lambda: made)
    else:
        yield from made


class _Split(InputPartition):
    """A split itself travels to its task, so that a list of splits is asked for once."""

    def __init__(self, value: object, of: int):
        super().__init__(value)
        self.of = of


def _read(make: Callable[[], SourceOperator], names: list[str], split: _Split) -> Iterator[pa.RecordBatch]:
    source, task = make(), TaskContext.get()
    source.open(OperatorContext(type(source).__name__, task.partitionId() if task else 0, split.of))
    try:
        for batch in _batches(source, split.value):
            yield batch.select(names)
    finally:
        source.close()


class _Reader(DataSourceReader):
    def __init__(self, make: Callable[[], SourceOperator], schema: T.StructType):
        self.make, self.names = make, schema.names

    def partitions(self) -> list[InputPartition]:
        splits = self.make().partitions()
        return [_Split(split, len(splits)) for split in splits]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        yield from _read(self.make, self.names, partition)


class _LiveReader(DataSourceStreamReader):
    def __init__(self, make: Callable[[], LiveSource], schema: T.StructType):
        self.make, self.names, self.source = make, schema.names, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "source": None}  # tasks build their own

    def _own(self) -> LiveSource:
        if self.source is None:
            self.source = self.make()
            self.source.open(OperatorContext(type(self.source).__name__))
        return self.source

    def initialOffset(self) -> dict:
        return self._own().first()

    def latestOffset(self) -> dict:
        return self._own().latest()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        splits = self._own().between(start, end)
        return [_Split(split, len(splits)) for split in splits]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        yield from _read(self.make, self.names, partition)

    def commit(self, end: dict) -> None:
        self._own().done(end)

    def stop(self) -> None:
        if self.source is not None:
            self.source.close()


def _registered(spark: SparkSession, make: Callable[[], SourceOperator]) -> str:
    schema = make().schema
    if schema is None:
        raise ValueError("a source must declare its schema")
    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    own = f"rillworks_{uuid.uuid4().hex}"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return own

        def schema(self) -> T.StructType:
            return declared

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Reader(make, declared)

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return _LiveReader(make, declared)

    spark.dataSource.register(Source)
    return own


def read(spark: SparkSession, make: Callable[[], SourceOperator]) -> DataFrame:
    """A frame over an authored source; `make` builds it on the driver and in every task."""
    return spark.read.format(_registered(spark, make)).load()


def read_live(spark: SparkSession, make: Callable[[], LiveSource]) -> DataFrame:
    """A live frame over an authored source that has no end."""
    return spark.readStream.format(_registered(spark, make)).load()


def sliced(spark: SparkSession, n: int, make_slice: Callable[[int], pa.Table], schema: T.StructType | str, parallelism: int | None = None) -> DataFrame:
    """A table made slice by slice: slice i is built in the task that reads it, and never on the driver."""
    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(declared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from make_slice(i).select(arrow.names).cast(arrow).to_batches()

    return spark.range(0, n, 1, parallelism or min(n, 1 << 16)).mapInArrow(run, declared)


def chunks(
    spark: SparkSession, selections: list, read_chunk: Callable, schema: T.StructType | str, max_in_flight: int = 8, partitions: int | None = None
) -> DataFrame:
    """Awaited chunk reads: `read_chunk(selection)` is a coroutine that gives a table.

    A task keeps `max_in_flight` reads going, hands tables on in their order and begins a read only
    when a table has been taken, so no more than `max_in_flight` of them wait.  Selections travel
    as rows: a task gets its own alone.
    """
    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(declared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (cloudpickle.loads(raw) for batch in batches for raw in batch.column(0).to_pylist())
        for _, table in _drive(lambda: _overlap(wanted, read_chunk, max_in_flight, True, None)):
            yield from table.select(arrow.names).cast(arrow).to_batches()

    rows = pa.table({"selection": pa.array([cloudpickle.dumps(s) for s in selections], pa.binary())})
    dealt = spark.createDataFrame(rows).repartition(partitions or max(1, min(len(selections), 4 * spark.sparkContext.defaultParallelism)))
    return dealt.mapInArrow(run, declared)
