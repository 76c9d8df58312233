"""The named pipelines: small ones that show a verb, and the benchmark shapes at any size."""

from __future__ import annotations

import asyncio
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks import tensors
from rillworks.functions import exprs
from rillworks.operators.joins import tags
from rillworks.sources import memory, synthetic
from rillworks.stream import Stream, source


def wordcount(spark: SparkSession) -> Stream:
    lines = memory.from_pydict(spark, line=["the quick brown fox", "the lazy dog", "the fox jumped", "the lazy fox ran"])
    return source(lines).tokenize("line").count_by("word")


def demo_stream(spark: SparkSession, interval: float = 0.2, max_batches: int | None = 20) -> Stream:
    return Stream(synthetic.demo_stream(spark, interval, max_batches)).count_by("key")


def image_embed(spark: SparkSession) -> Stream:
    images = np.random.default_rng(0).integers(0, 256, (7, 8, 8, 3), dtype=np.uint8)
    table = pa.table({"tile_id": list(range(7)), "image": pa.chunked_array([tensors.tensor_array(images)])})
    tiles = source(memory.from_table(spark, table))
    return tiles.map(lambda df: df.select("tile_id", tensors.with_shape(exprs.channel_means(F.col("image"), 64, 3), "embedding", [3])))


def scene_means(spark: SparkSession, items: list[tuple[str, str, str]], read: Callable[[str], np.ndarray], in_flight: int = 8) -> Stream:
    """Scenes to their mean NDVI: an injected reader decodes both bands, tiles are summed where they are read."""

    async def partials(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, red_ref, nir_ref in zip(*(c.to_pylist() for c in batch.columns)):
            red, nir = await asyncio.gather(asyncio.to_thread(read, red_ref), asyncio.to_thread(read, nir_ref))
            red, nir = red.astype(np.float64), nir.astype(np.float64)
            valid = (red + nir) > 0
            index = (nir[valid] - red[valid]) / (nir[valid] + red[valid])
            rows.append({"item_id": item, "ndvi_sum": float(index.sum()), "valid_count": int(valid.sum())})
        return pa.RecordBatch.from_pylist(rows, pa.schema([("item_id", pa.string()), ("ndvi_sum", pa.float64()), ("valid_count", pa.int64())]))

    scenes = spark.createDataFrame(items, "item_id string, red_href string, nir_href string").repartition(max(1, min(len(items), 64)))
    stream = source(scenes).map_async(partials, "item_id string, ndvi_sum double, valid_count long", max_in_flight=in_flight)
    return stream.weighted_mean("item_id", "ndvi_sum", "valid_count", "mean_ndvi")


def _busy(micros: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def spin(batch: pa.RecordBatch) -> pa.RecordBatch:
        end = time.perf_counter_ns() + micros * 1000
        while time.perf_counter_ns() < end:
            pass
        return batch

    return spin


async def _same(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch


def _waits(micros: int) -> Callable:
    async def wait(batch: pa.RecordBatch) -> pa.RecordBatch:
        await asyncio.sleep(micros / 1e6)
        return batch

    return wait


def bench_keyed(spark: SparkSession, rows: int = 200_000, keys: int = 500) -> Stream:
    return source(synthetic.keyed(spark, rows, keys)).count_by("key")


def bench_linear(spark: SparkSession, rows: int = 200_000, keys: int = 500) -> Stream:
    return source(synthetic.keyed(spark, rows, keys)).map(lambda df: df.select("*"))


def bench_chain(spark: SparkSession, rows: int = 200_000, keys: int = 1000) -> Stream:
    return bench_linear(spark, rows, keys).map(lambda df: df.select("*"))


def bench_fanout(spark: SparkSession, rows: int = 512, tokens: int = 500) -> Stream:
    return source(synthetic.text(spark, rows, tokens)).tokenize("line").count_by("word")


def bench_keyed_wide(spark: SparkSession, rows: int = 200_000, keys: int = 500) -> Stream:
    return source(synthetic.keyed(spark, rows, keys, payload_bytes=64, extra_values=8)).count_by("key")


def bench_join_wide(spark: SparkSession, rows: int = 200_000, keys: int = 500) -> Stream:
    wide = synthetic.join_table(spark, keys).select("*", *[(F.col("rval") + i).alias(f"r{i}") for i in range(8)])
    return source(synthetic.join_stream(spark, rows, keys)).join(source(wide), on="key")


def bench_skew(spark: SparkSession, rows: int = 200_000, keys: int = 500) -> Stream:
    return source(synthetic.keyed(spark, rows, keys, skew=1.5)).count_by("key")


def bench_backpressure(spark: SparkSession, rows: int = 200_000, keys: int = 500, micros: int = 100) -> Stream:
    return source(synthetic.keyed(spark, rows, keys)).map_arrow(_busy(micros), "key long, value long, ts long").count_by("key")


def bench_join(spark: SparkSession, rows: int = 200_000, keys: int = 500) -> Stream:
    return source(synthetic.join_stream(spark, rows, keys)).join(source(synthetic.join_table(spark, keys)), on="key")


def bench_async(spark: SparkSession, rows: int = 1_000_000, keys: int = 1000) -> Stream:
    return source(synthetic.keyed(spark, rows, keys)).map_async(_same)


def bench_async_io(spark: SparkSession, rows: int = 1_000_000, keys: int = 1000, micros: int = 200) -> Stream:
    return source(synthetic.keyed(spark, rows, keys)).map_async(_waits(micros))


def bench_keyed_mean(spark: SparkSession, rows: int = 200_000, keys: int = 500) -> Stream:
    return source(synthetic.keyed(spark, rows, keys)).keyed_mean("key", "value")


def geo_ndvi(spark: SparkSession, days: int = 3) -> Stream:
    grid = source(synthetic.grid(spark, days, bands=True))
    return grid.map(lambda df: df.select("gid", exprs.ndvi(F.col("nir"), F.col("red")).alias("ndvi")))


def geo_zonal(spark: SparkSession, days: int = 3) -> Stream:
    return source(synthetic.grid(spark, days)).keyed_mean("lat_idx", "value")


def geo_climatology(spark: SparkSession, days: int = 3) -> Stream:
    return source(synthetic.grid(spark, days)).keyed_mean("gid", "value", "clim")


def tag_regions(df: DataFrame, regions: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """Rows with the name of each box that holds them."""
    box = lambda bounds: exprs.in_box(F.col("latitude"), F.col("longitude"), tuple(map(F.lit, bounds)))
    return tags(df, "region", [(name, box(bounds)) for name, *bounds in regions])


def geo_zonal_vector(spark: SparkSession, days: int = 3) -> Stream:
    grid = source(synthetic.grid(spark, days, coords=True))
    return grid.map(lambda df: tag_regions(df, synthetic.REGIONS)).keyed_mean("region", "value")


def anomaly(rows: Stream, keys: tuple[str, ...], value: str) -> Stream:
    """Each row's value less the mean of its keys, by aggregating and joining back (null keys included)."""
    # the means hold a row per key, so hashing them per partition is cheaper than sorting all rows
    mean = rows.agg_by(keys, clim=(value, "mean")).map(lambda df: df.hint("shuffle_hash"))
    return rows.join(mean, on=keys).with_column("anomaly", F.col(value).cast("double") - F.col("clim"))


def geo_anomaly(spark: SparkSession, days: int = 3) -> Stream:
    return anomaly(source(synthetic.grid(spark, days)), ("gid",), "value")


def geo_forecast(spark: SparkSession, days: int = 1, replicas: int = 8) -> Stream:
    truth = source(synthetic.grid(spark, days, seed=11)).select("gid", "value").rename({"value": "temp_e"})
    forecast = source(synthetic.grid(spark, days, replicas=replicas)).select("gid", "replica", "value").rename({"value": "temp_f"})
    scored = forecast.join(truth, on="gid").with_column("se", exprs.squared_error(F.col("temp_f"), F.col("temp_e")))
    return scored.keyed_mean("replica", "se", "mse").with_column("rmse", F.sqrt("mse"))


PIPELINES: dict[str, Callable[[SparkSession], Stream]] = {
    "wordcount": wordcount,
    "demo-stream": demo_stream,
    "image-embed": image_embed,
    "bench-keyed": bench_keyed,
    "bench-keyed-wide": bench_keyed_wide,
    "bench-linear": bench_linear,
    "bench-chain": bench_chain,
    "bench-fanout": bench_fanout,
    "bench-skew": bench_skew,
    "bench-backpressure": bench_backpressure,
    "bench-join": bench_join,
    "bench-join-wide": bench_join_wide,
    "bench-async": bench_async,
    "bench-async-io": bench_async_io,
    "bench-keyed-mean": bench_keyed_mean,
    "bench-geo-ndvi": geo_ndvi,
    "bench-geo-zonal": geo_zonal,
    "bench-geo-climatology": geo_climatology,
    "bench-geo-zonal-vector": geo_zonal_vector,
    "bench-geo-anomaly": geo_anomaly,
    "bench-geo-forecast": geo_forecast,
}
