"""`Stream`: an immutable, lazy chain of verbs over a DataFrame, batch or live."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillworks.operators import aggs, arrow, joins, reshape
from rillworks.operators.author import AsyncOneInputOperator, AsyncSink, OneInputOperator, SourceOperator, TwoInputOperator
from rillworks.report import Node, RunReport, Watch
from rillworks.sources import connector, memory


class RunResult:
    """A finished run's rows as Arrow batches, with its report."""

    def __init__(self, table: pa.Table, report: RunReport):
        self._table, self._batches, self.report = table, table.to_batches(), report

    telemetry = property(lambda self: self.report)

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        return iter(self._batches)

    def __len__(self) -> int:
        return len(self._batches)

    def __getitem__(self, at: int) -> pa.RecordBatch:
        if not isinstance(at, int):
            raise TypeError("a result takes one index; use to_table() for ranges of rows")
        return self._batches[at]

    def to_table(self) -> pa.Table:
        return self._table

    def to_pylist(self) -> list[dict[str, Any]]:
        return self._table.to_pylist()

    def to_pydict(self) -> dict[str, list[Any]]:
        return self._table.to_pydict()


class Stream:
    """Verbs return new streams; nothing runs before `run` or `collect`."""

    def __init__(self, df: DataFrame, steps: tuple[str, ...] = ("source",), strict_keys: bool = False, node: Node | None = None):
        self.df, self.steps, self.strict_keys = df, steps, strict_keys
        self.node = node or Node(steps[-1])

    def _then(self, df: DataFrame, step: str, *others: Stream, counts: Accumulator | None = None) -> Stream:
        df, seen = self._observed(df) if self.node.seen is not None else (df, None)
        node = Node(step, (self.node, *(o.node for o in others)), seen, counts)
        return Stream(df, (*self.steps, step), self.strict_keys, node)

    @staticmethod
    def _observed(df: DataFrame) -> tuple[DataFrame, Observation | None]:
        if df.isStreaming:
            return df, None
        seen = Observation()
        return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen

    def counted(self) -> Stream:
        """From here on count the rows that leave each verb, for the report of one run.

        The counts stand between verbs in the plan, so filters don't move past them.
        """
        df, seen = self._observed(self.df)
        return Stream(df, self.steps, self.strict_keys, Node(self.node.step, self.node.inputs, seen, self.node.counts))

    def to_graph(self) -> dict:
        """The verbs as {"nodes": [{id, step}], "edges": [[from, to]]}, inputs first."""
        return self.node.graph()

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def lineage(self) -> tuple[str, ...]:
        return self.steps

    # row-wise verbs

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> Stream:
        """Any DataFrame to DataFrame function; it stays visible to the optimizer."""
        return self._then(fn(self.df), "map")

    def map_arrow(self, fn: arrow.BatchFn, schema: arrow.Schema | None = None, parallelism: int | None = None) -> Stream:
        df = self.df.repartition(parallelism) if parallelism else self.df
        return self._then(arrow.map_arrow(df, fn, schema), "map_arrow")

    def filter(self, mask: Column | Callable[[DataFrame], Column]) -> Stream:
        return self._then(reshape.keep(self.df, mask), "filter")

    def filter_arrow(self, mask: Callable[[pa.RecordBatch], pa.Array]) -> Stream:
        """As `filter`, by an opaque function over Arrow batches."""
        return self._then(arrow.keep_arrow(self.df, mask), "filter_arrow")

    def with_column_arrow(self, name: str, value: Callable[[pa.RecordBatch], pa.Array], kind: str | T.DataType | None = None) -> Stream:
        """As `with_column`, by an opaque function over Arrow batches; without a type, it is learnt from an empty batch."""
        return self._then(arrow.with_arrow(self.df, name, value, kind), "with_column_arrow")

    def select(self, *columns: str) -> Stream:
        return self._then(reshape.select(self.df, columns), "select")

    def drop(self, *columns: str) -> Stream:
        return self._then(reshape.drop(self.df, columns), "drop")

    def rename(self, mapping: dict[str, str]) -> Stream:
        return self._then(reshape.rename(self.df, mapping), "rename")

    def with_column(self, name: str, value: Column | Callable[[DataFrame], Column]) -> Stream:
        return self._then(reshape.with_column(self.df, name, value), "with_column")

    def tokenize(self, column: str, out: str = "word", *, lowercase: bool = True) -> Stream:
        return self._then(reshape.tokenize(self.df, column, out, lowercase), "tokenize")

    def explode(self, column: str) -> Stream:
        return self._then(reshape.explode(self.df, column), "explode")

    def flat_map(self, fn: Callable[[dict], Iterable[dict]], schema: arrow.Schema) -> Stream:
        return self._then(arrow.flat_map(self.df, fn, schema), "flat_map")

    def rebalance(self, parallelism: int | None = None) -> Stream:
        """Spread rows evenly over partitions."""
        return self._then(self.df.repartition(parallelism) if parallelism else self.df.hint("rebalance"), "rebalance")

    def spread(self, most_bytes: int = 1 << 30) -> Stream:
        """Deal a small input of few files to all cores: one row group is one task, whatever follows it.

        Larger inputs, and those of as many files as cores, stay as they are.
        """
        cores = self.df.sparkSession.sparkContext.defaultParallelism
        if self.df.isStreaming or len(self.df.inputFiles()) >= cores:
            return self
        size = int(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return self._then(self.df.repartition(cores), "spread") if size <= most_bytes else self

    # keyed verbs

    def count_by(self, key: str, count: str = "count") -> Stream:
        return self._then(aggs.count_by(self.df, key, count, self.strict_keys), f"count_by {key}")

    def agg_by(self, keys: str | Sequence[str], **outs: tuple[str, str]) -> Stream:
        return self._then(aggs.agg_by(self.df, keys, outs, self.strict_keys), f"agg_by {keys}")

    def keyed_mean(self, key: str, value: str, mean: str = "mean") -> Stream:
        return self._then(aggs.keyed_mean(self.df, key, value, mean), f"keyed_mean {key}")

    def weighted_mean(self, key: str, total: str, count: str, mean: str = "mean") -> Stream:
        return self._then(aggs.weighted_mean(self.df, key, total, count, mean), f"weighted_mean {key}")

    # several inputs

    def join(
        self,
        other: Stream,
        *,
        on: str | Sequence[str] | None = None,
        left_on: str | Sequence[str] | None = None,
        right_on: str | Sequence[str] | None = None,
        how: str = "inner",
    ) -> Stream:
        if other is self:
            raise ValueError("join: a stream can't join itself; build the other side as a stream of its own")
        return self._then(joins.join(self.df, other.df, on, left_on, right_on, how, self.strict_keys), f"join {how}", other)

    def union(self, *others: Stream) -> Stream:
        if not others:
            raise ValueError("union needs another stream")
        return self._then(reshape.union(self.df, *[o.df for o in others]), f"union {len(others) + 1}", *others)

    def apply_two(
        self, other: Stream, make: Callable[[], TwoInputOperator], schema: arrow.Schema, *, left_keys: Sequence[str], right_keys: Sequence[str]
    ) -> Stream:
        counts = arrow.counts_of(self.df)
        return self._then(arrow.apply_two(self.df, other.df, make, schema, tuple(left_keys), tuple(right_keys), counts), "apply_two", other, counts=counts)

    # authored operators

    def apply(
        self, make: Callable[[], OneInputOperator], schema: arrow.Schema, *, key_columns: Sequence[str] | None = None, parallelism: int | None = None
    ) -> Stream:
        keys = tuple(key_columns) if key_columns else make().key_columns()
        counts = arrow.counts_of(self.df)
        return self._then(arrow.apply(self.df, make, schema, keys, parallelism, counts), "apply", counts=counts)

    def map_async(
        self, fn: Callable, schema: arrow.Schema | None = None, *, max_in_flight: int = 8, ordered: bool = True
    ) -> Stream:
        return self._then(arrow.map_async(self.df, fn, schema, max_in_flight, ordered), "map_async")

    def apply_async(
        self, make: Callable[[], AsyncOneInputOperator], schema: arrow.Schema, *, key_columns: Sequence[str] | None = None, parallelism: int | None = None
    ) -> Stream:
        keys = tuple(key_columns) if key_columns else make().key_columns()
        counts = arrow.counts_of(self.df)
        return self._then(arrow.apply_async(self.df, make, schema, keys, parallelism, counts), "apply_async", counts=counts)

    def sink(self, make: Callable[[], AsyncSink], *, key_columns: Sequence[str] | None = None) -> SinkHandle:
        return SinkHandle(self, make, tuple(key_columns) if key_columns else make().key_columns())

    # terminals

    def run(self, *, parallelism: int | None = None, key_groups: int | None = None) -> RunResult:
        """Run and gather the result.  `parallelism` and `key_groups` set how many partitions a shuffle has."""
        spark = self.df.sparkSession
        wanted = _partitions(parallelism, key_groups)
        name = "spark.sql.shuffle.partitions"
        before = spark.conf.get(name)
        if wanted:
            spark.conf.set(name, str(wanted))
        try:
            if self.df.isStreaming:
                from rillworks.streaming.run import available_now

                began = time.perf_counter()
                table = available_now(self.df).toArrow()
                report = RunReport(list(self.steps), table.num_rows, time.perf_counter() - began)
                return RunResult(table, report)
            watch = Watch(self.df, self.node, self.steps)
            return RunResult(watch.df.toArrow(), watch.done())
        finally:
            spark.conf.set(name, before)

    def profile(self) -> RunReport:
        """Run for the report alone; no row leaves the executors."""
        watch = Watch(self.df, self.node, self.steps, plan=False)
        watch.df.write.format("noop").mode("overwrite").save()
        return watch.done()

    async def run_async(self, **options: int | None) -> RunResult:
        import asyncio

        return await asyncio.to_thread(self.run, **options)

    def collect(self, **options: int | None) -> list[dict[str, Any]]:
        return self.run(**options).to_pylist()

    def write(self, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), **options: Any) -> None:
        self.df.write.mode(mode).partitionBy(*partition_by).options(**options).format(format).save(path)


class SinkHandle:
    """A stream that ends in a sink; it can only run."""

    def __init__(self, stream: Stream, make: Callable[[], AsyncSink], keys: tuple[str, ...] | None):
        self.stream, self.make, self.keys = stream, make, keys

    def run(self, *, parallelism: int | None = None, key_groups: int | None = None) -> RunResult:
        df, wanted = self.stream.df, _partitions(parallelism, key_groups)
        if df.isStreaming:
            query = (
                df.writeStream.foreachBatch(lambda batch, _: arrow.write_async(batch, self.make, self.keys, wanted))
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
            return RunResult(pa.table({}), RunReport([*self.stream.steps, "sink"]))
        watch = Watch(df, self.stream.node, (*self.stream.steps, "sink"), plan=False)
        arrow.write_async(watch.df, self.make, self.keys, wanted)
        return RunResult(pa.table({}), watch.done())

    async def run_async(self, **options: int | None) -> RunResult:
        import asyncio

        return await asyncio.to_thread(self.run, **options)


def _partitions(parallelism: int | None, key_groups: int | None) -> int | None:
    for name, value in (("parallelism", parallelism), ("key_groups", key_groups)):
        if value is not None and value < 1:
            raise ValueError(f"{name} must be at least 1")
    if key_groups is not None and (key_groups > 32768 or key_groups < (parallelism or 1)):
        raise ValueError("key_groups must be at least the parallelism and at most 32768")
    return key_groups or parallelism


Input = DataFrame | pa.Table | pa.RecordBatch | Sequence[pa.RecordBatch] | str | Callable[[], SourceOperator]


def source(data: Input, spark: SparkSession | None = None, *, format: str = "parquet", strict_keys: bool = False, **options: Any) -> Stream:
    """Start a stream from a frame, Arrow data, a path, or a factory of an authored source."""
    if isinstance(data, DataFrame):
        return Stream(data, strict_keys=strict_keys)
    if spark is None:
        spark = SparkSession.getActiveSession()
        if spark is None:
            from rillworks.session import session

            spark = session()
    if isinstance(data, str):
        df = spark.read.format(format).options(**options).load(data)
    elif isinstance(data, (pa.Table, pa.RecordBatch)):
        df = memory.from_batches(spark, data)
    elif callable(data):
        df = connector.read(spark, data)
    elif isinstance(data, Sequence):
        df = memory.from_batches(spark, *data)
    else:
        raise TypeError(f"source: can't read {type(data).__name__}")
    return Stream(df, strict_keys=strict_keys)


def run(data: Input, verbs: Sequence[Callable[[Stream], Stream]] = (), spark: SparkSession | None = None, **options: int | None) -> RunResult:
    """One line: a source and a list of verbs, each a function of a stream."""
    stream = source(data, spark)
    for verb in verbs:
        stream = verb(stream)
    return stream.run(**options)
