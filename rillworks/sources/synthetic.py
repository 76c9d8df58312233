"""Generated inputs, built from `spark.range`, so any size is made where it is used."""

from __future__ import annotations

import asyncio
import math
import time
from collections.abc import AsyncIterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.operators.author import LiveSource
from rillworks.sources import connector

#: The regions of the zonal pipelines: name, lat_min, lat_max, lon_min, lon_max.
REGIONS = [
    ("north", 40.0, 60.0, 0.0, 120.0),
    ("tropics-west", -15.0, 15.0, 0.0, 90.0),
    ("tropics-east", -15.0, 15.0, 90.5, 180.0),
    ("south", -60.0, -40.0, 0.0, 120.0),
    ("pole", 75.0, 90.0, 0.0, 360.0),
]


#: Odd multipliers of the hash below, the first near 2^32 over the golden ratio.
MIX = (2654435769, 1597334677, 374761393)
#: Keys whose alias table goes into the plan; a larger table is joined.
TABLE_KEYS = 4096


def uniform(id_: Column, seed: int) -> Column:
    """A number in [0, 1) by a hash of the id: the same on every run, engine and partitioning (32 bits)."""
    word = F.lit(1 << 32).cast("long")
    low = id_.bitwiseAND(F.lit((1 << 31) - 1).cast("long")) * F.lit(MIX[0])
    high = F.shiftright(id_, 31) * F.lit(MIX[1])
    x = F.pmod(F.pmod(low, word) + F.pmod(high, word) + F.lit(seed * MIX[2] % (1 << 32)), word)
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(MIX[1]), word)
    return x.bitwiseXOR(F.shiftright(x, 13)).cast("double") / float(1 << 32)


def zipf_table(keys: int, skew: float) -> tuple[list[float], list[int]]:
    """(share, other) per key: the alias table of the law that gives key i a weight of (i + 1) ** -skew.

    Of the draws that fall on a key's equal slot its share stays, the rest goes to the other.
    """
    weight = [float(i + 1) ** -skew for i in range(keys)]
    total = math.fsum(weight)
    share, other = [w * keys / total for w in weight], list(range(keys))
    poor, rich = [i for i in range(keys) if share[i] < 1], [i for i in range(keys) if share[i] >= 1]
    while poor and rich:
        i, j = poor.pop(), rich[-1]
        other[i] = j
        share[j] -= 1 - share[i]
        if share[j] < 1:
            poor.append(rich.pop())
    for i in (*poor, *rich):  # what rounding left over
        share[i] = 1.0
    return share, other


def _zipf(rows: DataFrame, keys: int, skew: float, seed: int) -> DataFrame:
    """`rows` with a column key, by the inverse power law."""
    share, other = zipf_table(keys, skew)
    at = uniform(F.col("id"), seed) * float(keys)
    slot = F.floor(at).cast("int")
    pick = lambda s, o: F.when(at - F.floor(at) < s, slot).otherwise(o).cast("long").alias("key")
    if keys <= TABLE_KEYS:  # constants that the optimizer folds to one array each
        array = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
        return rows.select("*", pick(F.get(array(share, "double"), slot), F.get(array(other, "int"), slot)))
    table = rows.sparkSession.createDataFrame(list(zip(range(keys), share, other)), "slot int, share double, other int")
    return rows.withColumn("slot", slot).join(table, "slot").select("id", pick(F.col("share"), F.col("other")))


def keyed(
    spark: SparkSession,
    rows: int,
    keys: int = 1000,
    skew: float = 0.0,
    null_fraction: float = 0.0,
    payload_bytes: int = 0,
    extra_values: int = 0,
    value_spread: int = 0,
    partitions: int | None = None,
    seed: int = 7,
) -> DataFrame:
    """key, value, ts [, payload] [, v0...]: round-robin keys, or with skew by a zipf law of that exponent.

    `value` is 1, or with a spread uniform from 1 to it; the v columns are 1.  All draws hash the row's number.
    """
    ids = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    made = _zipf(ids, keys, skew, seed) if skew else ids.select("id", F.pmod("id", F.lit(keys)).alias("key"))
    key = F.when(uniform(F.col("id"), seed + 1) >= null_fraction, F.col("key")) if null_fraction else F.col("key")
    one = F.lit(1).cast("long")
    value = (F.floor(uniform(F.col("id"), seed + 2) * value_spread) + 1).cast("long") if value_spread else one
    out = made.select(key.alias("key"), value.alias("value"), F.col("id").alias("ts"))
    if payload_bytes:
        out = out.withColumn("payload", F.repeat(F.lit("x"), payload_bytes))
    return out.select("*", *[one.alias(f"v{i}") for i in range(extra_values)])


def text(spark: SparkSession, rows: int, tokens: int = 8, vocabulary: int = 1000) -> DataFrame:
    """line: `tokens` words each, round robin over w0, w1, ..."""
    word = lambda i: F.concat(F.lit("w"), F.pmod(F.col("id") * tokens + i, F.lit(vocabulary)).cast("string"))
    return spark.range(rows).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), word)).alias("line"))


def join_stream(spark: SparkSession, rows: int, keys: int) -> DataFrame:
    return spark.range(rows).select(F.pmod("id", F.lit(keys)).alias("key"), F.lit(1).cast("long").alias("lval"))


def join_table(spark: SparkSession, keys: int) -> DataFrame:
    return spark.range(keys).select(F.col("id").alias("key"), F.col("id").alias("rval"))


def grid(spark: SparkSession, days: int = 3, nlat: int = 72, nlon: int = 221, bands: bool = False, coords: bool = False, replicas: int = 0, seed: int = 5) -> DataFrame:
    """An hourly grid as rows: gid, value [, latitude, longitude] [, red, nir] [, replica]; gid repeats every day."""
    cells, hours = nlat * nlon, days * 24
    rows = spark.range(hours * cells * max(1, replicas))
    step = F.floor(F.col("id") / max(1, replicas)).cast("long")
    cell, hour = F.pmod(step, F.lit(cells)), F.floor(step / cells).cast("long")
    lat, lon = F.floor(cell / nlon).cast("long"), F.pmod(cell, F.lit(nlon))
    degrees = F.lit(90.0) - lat.cast("double") * (180.0 / max(1, nlat - 1))
    columns = [
        (cell * 24 + F.pmod(hour, F.lit(24))).alias("gid"),
        lat.cast("int").alias("lat_idx"),
        (F.cos(F.radians(degrees)) * 30 + F.sin(hour.cast("double") * (math.pi / 12)) * 5 + F.randn(seed)).alias("value"),
    ]
    if coords:
        columns += [degrees.alias("latitude"), (lon.cast("double") * (360.0 / nlon)).alias("longitude")]
    if bands:
        columns += [F.rand(seed).cast("float").alias("red"), F.rand(seed + 1).cast("float").alias("nir")]
    if replicas:
        columns.append(F.pmod("id", F.lit(replicas)).alias("replica"))
    return rows.select(*columns)


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "region string, lat_min double, lat_max double, lon_min double, lon_max double")


class Ticks(LiveSource):
    """(key, val) in batches of `rows` every `interval` seconds: `most` of them, or without an end.

    Bounded, it is one split that waits between its batches; live, its position is how many
    batches the time since it was opened has let out.
    """

    schema = "key string, val long"

    def __init__(self, interval: float = 0.2, most: int | None = 20, rows: int = 3, keys: tuple[str, ...] = ("a", "b", "c")):
        self.interval, self.most, self.rows, self.keys = interval, most, rows, keys
        self.began = time.monotonic()

    def partitions(self) -> list[tuple[int, int, bool]]:
        if self.most is None:
            raise ValueError("a source without an end is read live")
        return [(0, self.most, True)]

    def latest(self) -> dict:
        out = int((time.monotonic() - self.began) / self.interval) + 1 if self.interval else 1 << 20
        return {"at": out if self.most is None else min(out, self.most)}

    def between(self, start: dict, end: dict) -> list[tuple[int, int, bool]]:
        return [(start["at"], end["at"], False)] if end["at"] > start["at"] else []

    async def batches(self, partition: tuple[int, int, bool]) -> AsyncIterator[pa.RecordBatch]:
        first, last, paced = partition
        for n in range(first, last):
            if paced and n > first:
                await asyncio.sleep(self.interval)
            keys = [self.keys[(n + i) % len(self.keys)] for i in range(self.rows)]
            yield pa.RecordBatch.from_pydict({"key": keys, "val": [(n * self.rows + i) % 17 + 1 for i in range(self.rows)]})


def demo_stream(spark: SparkSession, interval: float = 0.2, max_batches: int | None = 20, rows_per_batch: int = 3, keys: tuple[str, ...] = ("a", "b", "c")) -> DataFrame:
    """A paced stream of (key, val): a bounded frame, or a live one where `max_batches` is None."""
    make = lambda: Ticks(interval, max_batches, rows_per_batch, keys)
    return connector.read_live(spark, make) if max_batches is None else connector.read(spark, make)
