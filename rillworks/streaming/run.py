"""Live inputs: the same verbs over `readStream`, ended by `availableNow`."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, format: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Files of a folder (or that match a glob) as a live frame; `max_files` per micro-batch is its backpressure."""
    reader = spark.readStream.schema(schema).format(format)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def checkpoint_path(spark: SparkSession) -> str:
    """A folder of its own for a query: in the shared checkpoint folder, or in the warehouse where the cluster names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/rillworks-checkpoint"
    return f"{base.rstrip('/')}/queries/{uuid.uuid4().hex}"


def _live_nodes(df: DataFrame) -> set[str]:
    """The kinds of plan nodes that live rows pass through; what is static stands still."""
    found, waiting = set(), [df._jdf.queryExecution().analyzed()]
    while waiting:
        node = waiting.pop()
        if node.isStreaming():
            found.add(node.getClass().getSimpleName())
            children = node.children()
            waiting += [children.apply(i) for i in range(children.size())]
    return found


@contextmanager
def _state_store(df: DataFrame) -> Iterator[None]:
    """While a query with custom state runs, state lives in RocksDB, which such state needs."""
    conf, name = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if not any("TransformWithState" in kind for kind in _live_nodes(df)):
        yield
        return
    before = conf.get(name, None)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def available_now(df: DataFrame, mode: str | None = None) -> DataFrame:
    """Run a live frame over all input there is, and return the answer as a table.

    An aggregation runs in complete mode: only the totals after the last
    micro-batch count, as at the end of a stream.  Other frames append.  Either
    way the answer is files in the checkpoint folder; none of it passes the driver.
    """
    spark, path = df.sparkSession, checkpoint_path(df.sparkSession)
    mode = mode or ("complete" if "Aggregate" in _live_nodes(df) else "append")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/check").trigger(availableNow=True)
    with _state_store(df):
        if mode == "append":
            query = writer.format("parquet").start(f"{path}/out")
        else:
            query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")).start()
        query.awaitTermination()
    jvm = spark.sparkContext._jvm
    out = jvm.org.apache.hadoop.fs.Path(f"{path}/out")
    if not out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(out):  # no micro-batch ran
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def write_stream(df: DataFrame, path: str, format: str = "parquet", mode: str = "append") -> None:
    """Append all available rows of a live frame to files, exactly once."""
    query = (
        df.writeStream.format(format)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint_path(df.sparkSession))
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()


def upsert_totals(df: DataFrame, path: str) -> None:
    """Overwrite a table with the totals of a live aggregation after every micro-batch."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint_path(df.sparkSession)).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_count(df: DataFrame, ts: str, key: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """An extension for event time: counts per key and window, late rows dropped past the watermark."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    counted = df.withWatermark(ts, late).groupBy(window.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "count")


def reduce_by_key(df: DataFrame, key: str, value: str, fold: Callable[[object, object], object]) -> DataFrame:
    """A reducing state per key over a live frame: (key, value) with the fold so far, in update mode.

    State needs the RocksDB provider, which `last_per_key` sets while it runs.  The last row of a key is its answer.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    kind, out = df.schema[key].dataType, df.schema[value].dataType
    state_schema = T.StructType([T.StructField("value", out)])

    class Fold(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("fold", state_schema)

        def handleInputRows(self, k, rows, timerValues):
            import pandas as pd

            old = self.state.get()[0] if self.state.exists() else None
            for frame in rows:
                for item in frame[value]:
                    if item is not None and item == item:
                        old = item if old is None else fold(old, item)
            if old is not None:
                self.state.update((old,))
            yield pd.DataFrame({key: [k[0]], value: [old]})

        def close(self) -> None: ...

    schema = T.StructType([T.StructField(key, kind), T.StructField(value, out)])
    return df.select(key, value).groupBy(key).transformWithStateInPandas(Fold(), schema, "Update", "None")


def last_per_key(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """Run `reduce_by_key` output over all available input and keep each key's last row.

    A micro-batch has a folder of its own, which it overwrites if it runs again.
    """
    path = checkpoint_path(spark)

    def put(batch: DataFrame, at: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/__at={at}")

    with _state_store(df):
        query = df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    values = [c for c in df.columns if c != key]
    schema = T.StructType([*df.schema.fields, T.StructField("__at", T.IntegerType())])
    rows = spark.read.schema(schema).option("basePath", f"{path}/out").parquet(f"{path}/out")
    return rows.groupBy(key).agg(*[F.max_by(F.col(c), F.col("__at")).alias(c) for c in values])
