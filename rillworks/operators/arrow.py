"""Adapters that run Arrow-batch Python inside Spark tasks.

Only callables that no column expression can stand for come here.  Batches move by
Arrow; keyed operators get their input hash-partitioned on the key, so that one
task sees all rows of a key, and flush when their partition ends.
"""

from __future__ import annotations

import asyncio
from collections import deque
from collections.abc import AsyncIterator, Awaitable, Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator, AccumulatorParam, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from rillworks.functions import checks
from rillworks.operators.author import AsyncOneInputOperator, AsyncSink, Collector, OneInputOperator, OperatorContext, TwoInputOperator
from rillworks.operators.reshape import quoted

BatchFn = Callable[[pa.RecordBatch], pa.RecordBatch]
Schema = str | T.StructType


def empty_batch(schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in arrow], schema=arrow)


def _shape(result: pa.RecordBatch) -> T.StructType:
    return from_arrow_schema(result.schema)


def _fit(batch: pa.RecordBatch, arrow: pa.Schema) -> pa.RecordBatch:
    """A batch under the declared schema; names must agree, types may widen."""
    if batch.schema.names != arrow.names:
        raise ValueError(f"a batch has the columns {batch.schema.names}, declared were {arrow.names}")
    return pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(batch.columns, arrow)], schema=arrow)


def _declared(schema: Schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def map_arrow(df: DataFrame, fn: BatchFn, schema: Schema | None = None) -> DataFrame:
    """Apply `fn` to each batch; without a schema, `fn` is called once on an empty batch to learn it."""
    declared = _declared(schema) if schema is not None else _shape(fn(empty_batch(df.schema)))
    arrow = to_arrow_schema(declared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _fit(fn(batch), arrow)

    return df.mapInArrow(run, declared)


def flat_map(df: DataFrame, fn: Callable[[dict], Iterable[dict]], schema: Schema, chunk: int = 4096) -> DataFrame:
    """Each row, as a dict, gives any number of rows; output leaves in chunks, however many there are."""
    declared = _declared(schema)
    arrow = to_arrow_schema(declared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                for made in fn(row):
                    rows.append(made)
                    if len(rows) >= chunk:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.mapInArrow(run, declared)


def keep_arrow(df: DataFrame, mask: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """Rows for which an opaque mask over Arrow batches is true; a null drops the row."""
    arrow = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _fit(batch.filter(mask(batch)), arrow)

    return df.mapInArrow(run, df.schema)


def with_arrow(df: DataFrame, name: str, value: Callable[[pa.RecordBatch], pa.Array], kind: str | T.DataType | None = None) -> DataFrame:
    """A column made by an opaque function over Arrow batches, at the end or in the place of its namesake."""
    checks.names("with_column_arrow", (name,))
    if kind is None:
        made = value(empty_batch(df.schema))
        kind = from_arrow_schema(pa.schema([(name, made.type)]))[name].dataType
    field = T.StructField(name, T.DataType.fromDDL(kind) if isinstance(kind, str) else kind)
    at = df.columns.index(name) if name in df.columns else len(df.columns)
    declared = T.StructType([*df.schema.fields[:at], field, *df.schema.fields[at + 1 :]])
    arrow = to_arrow_schema(declared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            columns[at : at + 1] = [value(batch)]
            yield _fit(pa.RecordBatch.from_arrays(columns, arrow.names), arrow)

    return df.mapInArrow(run, declared)


class CountsParam(AccumulatorParam):
    """Adds up the counters that operators kept in their tasks.  A task that runs again counts again."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, value1: dict, value2: dict) -> dict:
        return {name: value1.get(name, 0) + value2.get(name, 0) for name in {**value1, **value2}}


def counts_of(df: DataFrame) -> Accumulator:
    return df.sparkSession.sparkContext.accumulator({}, CountsParam())


def _context(name: str) -> OperatorContext:
    task = TaskContext.get()
    return OperatorContext(name, task.partitionId() if task else 0)


def _report(ctx: OperatorContext, counts: Accumulator | None) -> None:
    if counts is not None and ctx.metrics.counts:
        counts.add({f"{ctx.operator_id}.{name}": n for name, n in ctx.metrics.counts.items()})


def _partitioned(df: DataFrame, keys: tuple[str, ...] | None, parallelism: int | None) -> DataFrame:
    if keys:
        checks.present("apply", df, keys)
        columns = [quoted(k) for k in keys]
        return df.repartition(parallelism, *columns) if parallelism else df.repartition(*columns)
    return df.repartition(parallelism) if parallelism else df


def apply(
    df: DataFrame, make: Callable[[], OneInputOperator], schema: Schema, keys: tuple[str, ...] | None = None, parallelism: int | None = None,
    counts: Accumulator | None = None,
) -> DataFrame:
    """Run an operator per partition; `make` builds it inside the task."""
    declared = _declared(schema)
    arrow = to_arrow_schema(declared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        operator, out = make(), Collector()
        ctx = _context(type(operator).__name__)
        operator.open(ctx)
        try:
            for batch in batches:
                operator.process(batch, out)
                yield from (_fit(b, arrow) for b in out.drain())
            operator.on_eos(out)
            yield from (_fit(b, arrow) for b in out.drain())
        finally:
            operator.close()
            _report(ctx, counts)

    return _partitioned(df, keys, parallelism).mapInArrow(run, declared)


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; null equals null, NaN equals NaN."""
    old, new = column[:-1], column[1:]
    differs = pc.not_equal(new, old)
    if pa.types.is_floating(column.type):
        differs = pc.and_not(differs, pc.and_(pc.is_nan(new), pc.is_nan(old)))
    gone = pc.xor(pc.is_null(new), pc.is_null(old))
    return pc.or_(gone, pc.fill_null(differs, False)).to_numpy(zero_copy_only=False)


def apply_two(
    left: DataFrame, right: DataFrame, make: Callable[[], TwoInputOperator], schema: Schema, left_keys: tuple[str, ...], right_keys: tuple[str, ...],
    counts: Accumulator | None = None,
) -> DataFrame:
    """Run a two-input operator once per key that either side has.

    Both sides are dealt and sorted by key, the left rows of a key first, and pass through
    in batches: a key of any size never lies in memory whole.
    """
    declared = _declared(schema)
    arrow = to_arrow_schema(declared)
    shapes = [to_arrow_schema(side.schema) for side in (left, right)]
    names = [f"__key{i}" for i in range(len(left_keys))]

    def side(df: DataFrame, keys: tuple[str, ...], at: int) -> DataFrame:
        rows = [F.struct(*map(quoted, df.columns)) if i == at else F.lit(None).cast(x.schema) for i, x in enumerate((left, right))]
        return df.select(*[quoted(k).alias(n) for k, n in zip(keys, names)], F.lit(at).alias("__side"), rows[0].alias("__left"), rows[1].alias("__right"))

    both = side(left, left_keys, 0).union(side(right, right_keys, 1))
    dealt = both.repartition(*names).sortWithinPartitions(*names, "__side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, ctx, operator, last = Collector(), None, None, None

        def end() -> Iterator[pa.RecordBatch]:
            try:
                operator.on_eos(out)
                yield from (_fit(b, arrow) for b in out.drain())
            finally:
                operator.close()
                _report(ctx, counts)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i) for i in range(len(names))]
            of = np.ones(batch.num_rows, dtype=bool)
            of[1:] = np.logical_or.reduce([_changes(k) for k in keys])
            first = [k.slice(0, 1) for k in keys]
            if last is not None:
                of[0] = any(_changes(pa.concat_arrays([a, b]))[0] for a, b in zip(last, first))
            sides = batch.column(len(names)).to_numpy()
            cuts = np.flatnonzero(of | np.append(True, sides[1:] != sides[:-1])).tolist()
            for start, stop in zip(cuts, [*cuts[1:], batch.num_rows]):
                if of[start]:
                    if operator is not None:
                        yield from end()
                    operator = make()
                    ctx = _context(type(operator).__name__)
                    operator.open(ctx)
                at = int(sides[start])
                rows = batch.column(len(names) + 1 + at).slice(start, stop - start)
                part = _fit(pa.RecordBatch.from_arrays(rows.flatten(), shapes[at].names), shapes[at])
                (operator.process_right if at else operator.process_left)(part, out)
                yield from (_fit(b, arrow) for b in out.drain())
            last = [k.slice(batch.num_rows - 1, 1) for k in keys]
        if operator is not None:
            yield from end()

    return dealt.mapInArrow(run, declared)


async def _overlap(
    batches: Iterator[pa.RecordBatch], call: Callable[[pa.RecordBatch], Awaitable], in_flight: int, ordered: bool, timeout: float | None
) -> AsyncIterator[tuple[pa.RecordBatch, object]]:
    """(batch, result) with at most `in_flight` calls running; a failure cancels the rest."""
    if in_flight < 1:
        raise ValueError("max_in_flight must be at least 1")
    running: deque[tuple[pa.RecordBatch, asyncio.Task]] = deque()

    async def timed(batch: pa.RecordBatch) -> object:
        return await (asyncio.wait_for(call(batch), timeout) if timeout else call(batch))

    async def one() -> tuple[pa.RecordBatch, object]:
        done, _ = await asyncio.wait([t for _, t in running], return_when=asyncio.FIRST_COMPLETED)
        for task in done:  # a failed sibling ends the wait for the front
            if task.exception():
                raise task.exception()
        if not ordered:
            at = next(i for i, (_, t) in enumerate(running) if t in done)
            batch, task = running[at]
            del running[at]
            return batch, task.result()
        while not running[0][1].done():
            done, _ = await asyncio.wait([t for _, t in running if not t.done()], return_when=asyncio.FIRST_COMPLETED)
            for task in done:
                if task.exception():
                    raise task.exception()
        batch, task = running.popleft()
        return batch, task.result()

    try:
        for batch in batches:
            running.append((batch, asyncio.create_task(timed(batch))))
            if len(running) >= in_flight:
                yield await one()
        while running:
            yield await one()
    finally:
        for _, task in running:
            task.cancel()
        await asyncio.gather(*(t for _, t in running), return_exceptions=True)


def _drive(make: Callable[[], AsyncIterator]) -> Iterator:
    """Pull an async generator from synchronous code; its loop lives as long as the task."""
    with asyncio.Runner() as runner:
        stream = make()
        try:
            while True:
                try:
                    yield runner.run(anext(stream))
                except StopAsyncIteration:
                    return
        finally:
            runner.run(stream.aclose())


def map_async(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Awaitable[pa.RecordBatch]], schema: Schema | None = None, max_in_flight: int = 8, ordered: bool = True
) -> DataFrame:
    """Apply an awaited `fn` to each batch, several at once; without a schema the output has the input's."""
    declared = _declared(schema) if schema is not None else df.schema
    arrow = to_arrow_schema(declared)
    if max_in_flight < 1:
        raise ValueError("max_in_flight must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, result in _drive(lambda: _overlap(batches, fn, max_in_flight, ordered, None)):
            yield _fit(result, arrow)

    return df.mapInArrow(run, declared)


def apply_async(
    df: DataFrame, make: Callable[[], AsyncOneInputOperator], schema: Schema, keys: tuple[str, ...] | None = None, parallelism: int | None = None,
    counts: Accumulator | None = None,
) -> DataFrame:
    """Run an async operator per partition: fetches overlap, integration is serial."""
    sample = make()
    if keys and not sample.ordered():
        raise ValueError("apply_async: a keyed operator must be ordered")
    declared = _declared(schema)
    arrow = to_arrow_schema(declared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        async def steps() -> AsyncIterator[pa.RecordBatch]:
            operator, out = make(), Collector()
            ctx = _context(type(operator).__name__)
            operator.open(ctx)
            limit = operator.timeout_micros()
            try:
                ctx.store.open = False  # while fetches run; integration and the end are synchronous
                async for batch, result in _overlap(batches, operator.fetch, operator.max_in_flight(), operator.ordered(), limit and limit / 1e6):
                    ctx.store.open = True
                    operator.integrate(batch, result, ctx, out)
                    ctx.store.open = False
                    for made in out.drain():
                        yield made
                ctx.store.open = True
                operator.on_eos(ctx, out)
                for made in out.drain():
                    yield made
            finally:
                await operator.close()
                _report(ctx, counts)

        yield from (_fit(b, arrow) for b in _drive(steps))

    return _partitioned(df, keys, parallelism).mapInArrow(run, declared)


def write_async(df: DataFrame, make: Callable[[], AsyncSink], keys: tuple[str, ...] | None = None, parallelism: int | None = None) -> None:
    """Write every batch through a sink, on the executors; returns when all writes have ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        async def steps() -> AsyncIterator[int]:
            sink = make()
            sink.open(_context(type(sink).__name__))
            limit = sink.timeout_micros()
            try:
                async for batch, _ in _overlap(batches, sink.write, sink.max_in_flight(), False, limit and limit / 1e6):
                    yield batch.num_rows
            finally:
                await sink.close()

        for rows in _drive(steps):
            yield pa.RecordBatch.from_arrays([pa.array([rows])], ["rows"])

    _partitioned(df, keys, parallelism).mapInArrow(run, "rows long").agg({"rows": "sum"}).collect()  # one row
