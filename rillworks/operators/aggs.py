"""Keyed aggregation: count_by, agg_by, keyed_mean and weighted_mean.

All of them plan as partial and final HashAggregate around one exchange, so a
hot key is summed up before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillworks.functions import checks
from rillworks.operators.reshape import quoted

FUNCTIONS = ("sum", "count", "mean", "min", "max")


def _wide(df: DataFrame, column: str) -> Column:
    """Integers as 64-bit, floats as doubles, other types as they are."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return quoted(column).cast("long")
    if isinstance(kind, T.FloatType):
        return quoted(column).cast("double")
    return quoted(column)


def _key(df: DataFrame, column: str) -> Column:
    key = quoted(column)
    return (key.cast("long") if isinstance(df.schema[column].dataType, T.IntegralType) else key).alias(column)


def count_by(df: DataFrame, key: str, count: str = "count", strict_keys: bool = False) -> DataFrame:
    """COUNT(*) per key; null is a key of its own, and the key keeps its type."""
    checks.keys("count_by", df, (key,), strict_keys)
    checks.names("count_by", (key, count))
    return df.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias(count))


def _aggregate(df: DataFrame, column: str, function: str) -> Column:
    if function == "count":
        return F.count(quoted(column))
    if function == "mean":
        return F.avg(quoted(column).cast("double"))
    return {"sum": F.sum, "min": F.min, "max": F.max}[function](_wide(df, column))


def agg_by(df: DataFrame, keys: str | Sequence[str], outs: Mapping[str, tuple[str, str]], strict_keys: bool = False) -> DataFrame:
    """Grouped aggregates; `outs` maps each output to (input column, function)."""
    keys = checks.names("agg_by", (keys,) if isinstance(keys, str) else tuple(keys))
    if not outs:
        raise ValueError("agg_by needs at least one aggregation")
    for name, spec in outs.items():
        if not isinstance(spec, tuple) or len(spec) != 2 or not all(isinstance(s, str) for s in spec):
            raise TypeError(f"agg_by: {name} must be (column, function), not {spec!r}")
        if spec[1] not in FUNCTIONS:
            raise ValueError(f"agg_by: no function {spec[1]!r}; there are {', '.join(FUNCTIONS)}")
        if name in keys:
            raise ValueError(f"agg_by: output {name!r} has the name of a key")
        if name == "parallelism":
            raise ValueError("agg_by: the name parallelism is reserved")
    checks.keys("agg_by", df, keys, strict_keys)
    checks.present("agg_by", df, [column for column, _ in outs.values()])
    aggregates = [_aggregate(df, column, function).alias(name) for name, (column, function) in outs.items()]
    return df.groupBy(*[_key(df, k) for k in keys]).agg(*aggregates)


def keyed_mean(df: DataFrame, key: str, value: str, mean: str = "mean") -> DataFrame:
    """Mean of the non-null values per key and their number `n`; NaN carries through."""
    checks.present("keyed_mean", df, (key, value))
    checks.names("keyed_mean", (key, mean, "n"))
    column = quoted(value).cast("double")
    return df.groupBy(_key(df, key)).agg(F.avg(column).alias(mean), F.count(column).alias("n"))


def weighted_mean(df: DataFrame, key: str, total: str, count: str, mean: str = "mean") -> DataFrame:
    """Sum of totals over sum of counts per key; NaN where the counts add up to zero."""
    checks.present("weighted_mean", df, (key, total, count))
    sums = df.groupBy(_key(df, key)).agg(
        F.coalesce(F.sum(quoted(total).cast("double")), F.lit(0.0)).alias("_total"),
        F.coalesce(F.sum(_wide(df, count)), F.lit(0)).alias("_count"),
    )
    value = F.when(F.col("_count") == 0, F.lit(float("nan"))).otherwise(F.col("_total") / F.col("_count"))
    return sums.select(quoted(key), value.alias(mean), F.col("_count").alias(count))
