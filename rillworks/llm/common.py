"""Helpers shared by the text operators: scratch tables, ASCII rules, folds."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.session import let_workers_import

#: The ASCII white space that separates words and surrounds lines.
ASCII_SPACE = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows and bytes of an Arrow batch handed to Python; texts may be long.
ARROW_ROWS = 500
ARROW_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or one in the warehouse where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    return path.rstrip("/") if path else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/rillworks-checkpoint"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rillworks/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends at files every executor can reach."""
    return materialize_at(df, name)[0]


def materialize_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `materialize`, with the path, for tables that can be removed before the job ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def small_batches(spark: SparkSession) -> None:
    """Before Python runs: bound the rows of an Arrow batch, so that long texts don't fill a worker."""
    let_workers_import(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def plain_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of inputs partitioned alike for partitioned alike itself, but a columnar
    union lays their partitions side by side, and a key of two inputs stays two rows."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  `lower` equals it on pure ASCII, where it is far cheaper."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo `n`; an id that is null falls in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def quiet_threads() -> None:
    """In a worker: libraries keep to the task's own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
