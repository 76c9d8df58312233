"""Joins against a plain Python reference."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.conftest import multiset

from rillworks import source
from rillworks.operators.joins import bucket_join, interval_join, range_join, tags

HOWS = ("inner", "left", "right", "outer")


def reference(left, right, how):
    """Rows (key, lval) and (key, rval); null keys match."""
    out = [(k, a, b) for k, a in left for k2, b in right if k == k2]
    if how in ("left", "outer"):
        out += [(k, a, None) for k, a in left if all(k != k2 for k2, _ in right)]
    if how in ("right", "outer"):
        out += [(k, None, b) for k, b in right if all(k != k2 for k2, _ in left)]
    return out


def side(spark, rows, *names, types=None):
    columns = list(zip(*rows)) or [[] for _ in names]
    return source(pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, columns, types or (pa.int64(), pa.string()))}), spark)


def tuples(stream):
    return [tuple(r.values()) for r in stream.collect()]


@pytest.mark.parametrize("how", HOWS)
def test_all_hows(spark, how):
    left = [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "n")]
    right = [(1, "x"), (2, "y"), (2, "z"), (4, "w"), (None, "m"), (None, "o")]
    got = side(spark, left, "id", "lval").join(side(spark, right, "id", "rval"), on="id", how=how)
    assert got.columns == ["id", "lval", "rval"]
    assert multiset(tuples(got)) == multiset(reference(left, right, how))


@pytest.mark.parametrize("how", HOWS)
def test_random(spark, how):
    rng = random.Random(hash(how) % 100)
    rows = lambda tag: [(rng.choice([None, *range(8)]), f"{tag}{i}") for i in range(rng.randrange(40))]
    for _ in range(3):
        left, right = rows("l"), rows("r")
        got = side(spark, left, "id", "lval").join(side(spark, right, "id", "rval"), on="id", how=how)
        assert multiset(tuples(got)) == multiset(reference(left, right, how))


def test_right_join_with_other_names_keeps_the_left_key_name(spark):
    got = side(spark, [(1, "a")], "lid", "lval").join(side(spark, [(1, "x"), (2, "y")], "rid", "rval"), left_on="lid", right_on="rid", how="right")
    assert got.columns == ["lid", "lval", "rval"]
    assert multiset(tuples(got)) == multiset([(1, "a", "x"), (2, None, "y")])


def test_composite(spark):
    left = source(pa.table({"a": [1, 1, None], "b": ["x", "y", "x"], "l": [1, 2, 3]}), spark)
    right = source(pa.table({"a": [1, None, 1], "b": ["x", "x", "z"], "r": [7, 8, 9]}), spark)
    assert multiset(tuples(left.join(right, on=["a", "b"]))) == multiset([(1, "x", 1, 7), (None, "x", 3, 8)])


@pytest.mark.parametrize("how", HOWS)
def test_key_types(spark, how):
    ints = side(spark, [(1, "a"), (0, "b")], "k", "l")
    narrow = side(spark, [(1, "x")], "k", "r", types=(pa.int32(), pa.string()))
    flags = side(spark, [(True, "x")], "k", "r", types=(pa.bool_(), pa.string()))
    words = side(spark, [("1", "x")], "k", "r", types=(pa.string(), pa.string()))
    assert (1, "a", "x") in tuples(ints.join(narrow, on="k", how=how))
    for other in (flags, words):
        assert all(r[1] is None or r[2] is None for r in tuples(ints.join(other, on="k", how=how)))


def test_empty_side(spark):
    empty = source(pa.table({"id": pa.array([], pa.int64()), "r": pa.array([], pa.string())}), spark)
    left = side(spark, [(1, "a"), (2, "b")], "id", "l")
    assert multiset(tuples(left.join(empty, on="id", how="left"))) == multiset([(1, "a", None), (2, "b", None)])
    assert multiset(tuples(empty.join(left, on="id", how="outer"))) == multiset([(1, None, "a"), (2, None, "b")])


def test_rejects(spark):
    a, b = side(spark, [(1, "a")], "id", "v"), side(spark, [(1, "x")], "id", "v")
    with pytest.raises(ValueError):
        a.join(b, on="id")  # v on both sides
    with pytest.raises(ValueError):
        a.join(a, on="id")
    with pytest.raises(ValueError):
        a.join(b.drop("v"), on="id", how="semi")
    with pytest.raises(ValueError):
        a.join(b.drop("v"))
    with pytest.raises(ValueError):
        a.join(b.drop("v"), left_on="id")
    with pytest.raises(ValueError):
        a.join(b.drop("v"), left_on=["id", "v"], right_on=["id"])
    with pytest.raises(KeyError):
        a.join(b.drop("v"), on="nope")


def test_null_safe_join_is_not_a_nested_loop(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = side(spark, [(1, "a")], "id", "l"), side(spark, [(1, "x")], "id", "r")
        plan = left.join(right, on="id").df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_range_joins_agree_and_check_their_side(spark):
    points = spark.range(100).select(F.col("id"), F.col("id").cast("double").alias("x"))
    ranges = spark.createDataFrame([("a", 3.0, 17.0), ("b", 10.0, 30.0), ("c", 95.0, 200.0)], "name string, lo double, hi double")
    want = multiset((i, n) for i in range(100) for n, lo, hi in (("a", 3, 17), ("b", 10, 30), ("c", 95, 200)) if lo <= i <= hi)
    plain = range_join(points, ranges, F.col("x").between(F.col("lo"), F.col("hi")))
    bucketed = bucket_join(points, ranges, "x", "lo", "hi", 7.0)
    for got in (plain, bucketed):
        assert multiset((r.id, r.name) for r in got.collect()) == want
    wide = ranges.union(spark.createDataFrame([("d", -1e12, 1e12), ("e", 5.0, 5.0), ("f", 9.0, 8.0)], ranges.schema))
    more = want + multiset((i, "d") for i in range(100)) + multiset([(5, "e")])
    for got in (bucket_join(points, wide, "x", "lo", "hi", 0.5), interval_join(points, wide, "x", "lo", "hi", 7.0), interval_join(points, wide, "x", "lo", "hi", 7.0, rows=2)):
        assert got.columns == ["id", "x", "name", "lo", "hi"] and multiset((r.id, r.name) for r in got.collect()) == more
    tagged = tags(points, "name", [(n, F.col("x").between(lo, hi)) for n, lo, hi in (("a", 3, 17), ("b", 10, 30), ("c", 95, 200))])
    assert multiset((r.id, r.name) for r in tagged.collect()) == want
    for bound in ({"rows": 2}, {"size": 50}):
        with pytest.raises(ValueError):
            range_join(points, ranges, F.lit(True), **bound)


@pytest.mark.parametrize("how", ("right", "outer"))
def test_a_key_the_left_type_cannot_hold_fails(spark, how):
    left = side(spark, [(1, "a")], "k", "l", types=(pa.int32(), pa.string()))
    fits, too_large = side(spark, [(2**31 - 1, "x"), (None, "n")], "k", "r"), side(spark, [(2**40, "x")], "k", "r")
    got = left.join(fits, on="k", how=how)
    assert got.df.dtypes[0] == ("k", "int") and (2**31 - 1, None, "x") in tuples(got) and (None, None, "n") in tuples(got)
    with pytest.raises(Exception, match="can't hold 1099511627776"):
        left.join(too_large, on="k", how=how).run()
    assert tuples(left.join(too_large, on="k", how="left")) == [(1, "a", None)]
