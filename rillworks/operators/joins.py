"""Equi-joins on typed, null-safe keys, and range joins against a checked-small side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillworks.functions import checks
from rillworks.operators.reshape import quoted

HOWS = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}
#: Rows and bytes of a range join's right side that may be broadcast: every left row meets every one of them.
RANGE_ROWS, RANGE_BYTES = 512, 4 << 20


def key_pairs(
    on: str | Sequence[str] | None, left_on: str | Sequence[str] | None, right_on: str | Sequence[str] | None
) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The key columns of both sides, from `on` or from `left_on` with `right_on`."""
    if (on is None) == (left_on is None and right_on is None) or (left_on is None) != (right_on is None):
        raise ValueError("join: give either on, or both left_on and right_on")
    many = lambda x: (x,) if isinstance(x, str) else tuple(x)
    left, right = (many(on), many(on)) if on is not None else (many(left_on), many(right_on))
    if len(left) != len(right):
        raise ValueError(f"join: {len(left)} left keys but {len(right)} right keys")
    return checks.names("join", left), checks.names("join", right)


def _matches(left: DataFrame, right: DataFrame, a: str, b: str, right_key: Column) -> Column:
    """Null-safe equality; keys of different type classes never match."""
    kinds = [checks.type_class(df.schema[c].dataType) for df, c in ((left, a), (right, b))]
    if "null" in kinds and kinds[0] != kinds[1]:
        return quoted(a).isNull() & right_key.isNull()
    if kinds[0] != kinds[1]:
        return F.lit(False)
    if kinds[0] == "integer":
        return quoted(a).cast("long").eqNullSafe(right_key.cast("long"))
    return quoted(a).eqNullSafe(right_key)


def join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | None = None,
    left_on: str | Sequence[str] | None = None,
    right_on: str | Sequence[str] | None = None,
    how: str = "inner",
    strict_keys: bool = False,
) -> DataFrame:
    """Left columns, then right columns without the keys; null keys match null keys.

    An unmatched right row puts its key, cast to the left type, in the left key
    column; a key that the left type can't hold fails the job.  The planner picks the
    strategy; AQE splits skewed partitions.
    """
    lkeys, rkeys = key_pairs(on, left_on, right_on)
    if how not in HOWS:
        raise ValueError(f"join: no how {how!r}; there are {', '.join(HOWS)}")
    checks.keys("join, left", left, lkeys, strict_keys)
    checks.keys("join, right", right, rkeys, strict_keys)
    rest = [c for c in right.columns if c not in rkeys]
    if clash := [c for c in rest if c in left.columns]:
        raise ValueError(f"join: both sides have {clash}; rename or drop one")
    if left.isStreaming and right.isStreaming and how != "inner":
        raise ValueError("join: two live streams join inner only; an outer join must know when a side ends")
    keys = [f"__right_key_{i}" for i in range(len(rkeys))]
    there = right.select(*[quoted(c).alias(k) for c, k in zip(rkeys, keys)], *map(quoted, rest))
    condition = reduce(lambda x, y: x & y, [_matches(left, right, a, b, F.col(k)) for a, b, k in zip(lkeys, rkeys, keys)])
    joined = left.join(there, condition, HOWS[how])

    def own(column: str) -> Column:
        if column not in lkeys or how in ("inner", "left"):
            return quoted(column)
        key = F.col(keys[lkeys.index(column)])
        left_kind, right_kind = left.schema[column].dataType, right.schema[rkeys[lkeys.index(column)]].dataType
        if left_kind != right_kind:
            there_is = key.isNotNull() & key.try_cast(left_kind).isNull()
            wrong = F.raise_error(F.concat(F.lit(f"join: the left key {column} of type {left_kind.simpleString()} can't hold "), key.cast("string")))
            key = F.when(there_is, wrong.cast(left_kind)).otherwise(key.try_cast(left_kind))
        return F.coalesce(quoted(column), key).alias(column)

    return joined.select(*map(own, left.columns), *map(quoted, rest))


def range_join(
    left: DataFrame, ranges: DataFrame, condition: Column, how: str = "inner", rows: int = RANGE_ROWS, size: int = RANGE_BYTES
) -> DataFrame:
    """Join on any condition against a bounded set of ranges.

    The ranges and their bytes are counted up to the bounds first; they are broadcast only within
    them.  Larger sets need an equi-join on buckets of the ranged value instead (`interval_join`
    picks one of the two).
    """
    if not _small(ranges, rows, size):
        raise ValueError(f"range_join: more than {rows} ranges or {size} bytes; use interval_join or bucket_join")
    return left.join(F.broadcast(ranges), condition, how)


def _small(ranges: DataFrame, rows: int, size: int) -> bool:
    width = F.octet_length(F.to_json(F.struct(*map(quoted, ranges.columns))))
    n, total = ranges.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and total <= size


def bucket_join(left: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Inner join on low <= value <= high for any number of ranges: both sides go to buckets and meet by equality.

    A range goes to the level whose buckets, `width` times a power of two, are as wide as the range
    or wider, so to two buckets at most; a value goes to its bucket of every level in use.
    """
    size = lambda level: F.lit(float(width)) * F.pow(F.lit(2.0), level)
    span = (quoted(high) - quoted(low)).cast("double") / width
    level = F.when(span <= 1, F.lit(0)).otherwise(F.ceil(F.log2(span))).cast("int")
    bucket = lambda c, at: F.floor(quoted(c).cast("double") / size(at))
    placed = ranges.where(quoted(low) <= quoted(high)).withColumn("__level", level)
    # one row per power of two between the narrowest range and the widest
    used = sorted(r["__level"] for r in placed.select("__level").distinct().collect())
    at = F.col("__level")
    there = placed.withColumn("__bucket", F.explode(F.sequence(bucket(low, at), bucket(high, at))))
    here = left.withColumn("__level", F.explode(F.array(*map(F.lit, used)) if used else F.expr("cast(array() as array<int>)"))).withColumn("__bucket", bucket(value, at))
    return here.join(there, ["__level", "__bucket"]).where(quoted(value).between(quoted(low), quoted(high))).drop("__level", "__bucket")


def interval_join(
    left: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float, rows: int = RANGE_ROWS, size: int = RANGE_BYTES
) -> DataFrame:
    """Inner join on low <= value <= high: broadcast where the ranges are few and small, else on buckets."""
    if _small(ranges, rows, size):
        return left.join(F.broadcast(ranges), quoted(value).between(quoted(low), quoted(high)))
    return bucket_join(left, ranges, value, low, high, width)


def tags(df: DataFrame, out: str, cases: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per case that holds, with its name in `out`; the cases are part of the plan, so nothing is shuffled or broadcast."""
    held = F.array(*[F.when(condition, F.lit(name)) for name, condition in cases])
    return df.select("*", F.explode(held).alias(out)).where(quoted(out).isNotNull())
