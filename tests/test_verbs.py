"""Row-wise verbs, aggregates and unions against literal fixtures."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.conftest import multiset

from rillworks import source


def make(spark, schema=None, **columns):
    return source(pa.table(columns, schema=schema), spark)


def rows(stream):
    return stream.collect()


def test_tokenize(spark):
    s = make(spark, line=["  the   cat  ", "", "dog\t\nfox", None]).tokenize("line")
    assert s.columns == ["word"]
    assert multiset(rows(s)) == multiset({"word": w} for w in ("the", "cat", "dog", "fox"))


def test_tokenize_is_str_split(spark):
    rng = random.Random(3)
    letters = "aB \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　é​"
    lines = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(300)]
    for lower in (True, False):
        got = rows(make(spark, line=lines).tokenize("line", "w", lowercase=lower))
        assert multiset(got) == multiset({"w": w} for x in lines for w in (x.lower() if lower else x).split())


def test_wordcount(spark):
    s = make(spark, line=["the cat sat", "the dog ran", "the cat the cat"]).tokenize("line").count_by("word")
    assert {r["word"]: r["count"] for r in rows(s)} == {"the": 4, "cat": 3, "sat": 1, "dog": 1, "ran": 1}


FIVE = {"s": ("v", "sum"), "c": ("v", "count"), "m": ("v", "mean"), "lo": ("v", "min"), "hi": ("v", "max")}


def test_agg_by_integer_key(spark):
    got = {r["k"]: r for r in rows(make(spark, k=[0, 1, 0, 2, 1], v=[1.0, 2.0, 3.0, 4.0, 5.0]).agg_by("k", **FIVE))}
    assert got[0] == {"k": 0, "s": 4, "c": 2, "m": 2, "lo": 1, "hi": 3}
    assert got[1] == {"k": 1, "s": 7, "c": 2, "m": 3.5, "lo": 2, "hi": 5}
    assert got[2] == {"k": 2, "s": 4, "c": 1, "m": 4, "lo": 4, "hi": 4}


def test_agg_by_composite_and_nulls(spark):
    got = rows(make(spark, k=[0, 0, 1], g=["x", "y", "x"], v=[2.0, 4.0, 6.0]).agg_by(["k", "g"], s=("v", "sum")))
    assert multiset(got) == multiset([{"k": 0, "g": "x", "s": 2.0}, {"k": 0, "g": "y", "s": 4.0}, {"k": 1, "g": "x", "s": 6.0}])
    got = {r["k"]: r for r in rows(make(spark, k=["a", "b", "b", "a"], v=[None, None, None, 3.0]).agg_by("k", **FIVE))}
    assert got["b"] == {"k": "b", "s": None, "c": 0, "m": None, "lo": None, "hi": None}
    assert got["a"]["s"] == 3
    got = {r["k"]: r["s"] for r in rows(make(spark, k=[None, 0, None, -1], v=[9, 4, 1, 9]).agg_by("k", s=("v", "sum")))}
    assert got == {None: 10, 0: 4, -1: 9}


def test_types_of_aggregates(spark):
    table = pa.table({"k": pa.array([1, 2, 1], pa.int8()), "v": pa.array([2, 3, 4], pa.int32()), "f": pa.array([1, 2, 3], pa.float32())})
    s = source(table, spark).agg_by("k", s=("v", "sum"), lo=("v", "min"), hi=("v", "max"), m=("v", "mean"), fs=("f", "min"))
    assert dict(s.df.dtypes) == {"k": "bigint", "s": "bigint", "lo": "bigint", "hi": "bigint", "m": "double", "fs": "double"}
    counted = source(table, spark).count_by("k")
    assert dict(counted.df.dtypes) == {"k": "tinyint", "count": "bigint"}


def test_keyed_mean(spark):
    got = {r["k"]: r for r in rows(make(spark, k=[1, 1, None, 2, 3, 3], v=[1.0, None, 5.0, None, float("nan"), 1.0]).keyed_mean("k", "v"))}
    assert got[1] == {"k": 1, "mean": 1.0, "n": 1}
    assert got[None]["mean"] == 5
    assert got[2] == {"k": 2, "mean": None, "n": 0}
    assert math.isnan(got[3]["mean"])


def test_weighted_mean(spark):
    got = {r["k"]: r for r in rows(make(spark, k=["a", "a", "b"], t=[1.0, 3.0, 0.0], n=[1, 3, 0]).weighted_mean("k", "t", "n"))}
    assert got["a"] == {"k": "a", "mean": 1.0, "n": 4}
    assert math.isnan(got["b"]["mean"]) and got["b"]["n"] == 0


def test_agg_by_rejects(spark):
    s = make(spark, k=[1], v=[1])
    for bad, error in [
        ({}, ValueError),
        ({"x": ("v", "median")}, ValueError),
        ({"k": ("v", "sum")}, ValueError),
        ({"x": "v"}, TypeError),
        ({"x": ("w", "sum")}, KeyError),
        ({"parallelism": ("v", "sum")}, ValueError),
    ]:
        with pytest.raises(error):
            s.agg_by("k", **bad)
    with pytest.raises(ValueError):
        s.agg_by([], x=("v", "sum"))
    with pytest.raises(TypeError):
        source(pa.table({"k": [1.5]}), spark, strict_keys=True).count_by("k")


def test_reshaping(spark):
    s = make(spark, id=[1, 2], lval=["a", "b"], scratch=[9, 8])
    assert s.select("lval", "id").columns == ["lval", "id"]
    assert s.drop("scratch").columns == ["id", "lval"]
    assert s.rename({"id": "key", "lval": "v"}).columns == ["key", "v", "scratch"]
    assert rows(s.with_column("id", F.col("id") * 10).select("id", "lval"))[0] == {"id": 10, "lval": "a"}
    assert s.with_column("id", F.lit(1)).columns == s.columns
    assert rows(s.with_column("twice", lambda df: df.id * 2).select("twice"))[1] == {"twice": 4}
    for bad in (lambda: s.select("nope"), lambda: s.drop("nope"), lambda: s.rename({"nope": "x"}), lambda: s.tokenize("nope")):
        with pytest.raises(KeyError):
            bad()
    for bad in (lambda: s.select(), lambda: s.select("id", "id"), lambda: s.drop(" "), lambda: s.rename({"id": "lval"}), lambda: s.rename({})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        s.explode("id")


def test_names_are_case_sensitive(spark):
    s = make(spark, a=[1], A=[2])
    assert rows(s.select("A")) == [{"A": 2}]
    with pytest.raises(KeyError):
        s.select("B")


def test_filter_drops_null_mask(spark):
    assert rows(make(spark, v=[1, None, 3]).filter(F.col("v") > 1)) == [{"v": 3}]


def test_explode(spark):
    s = make(spark, id=[1, 2, 3, 4], tags=[["a", "b"], [], ["c", None], None], z=[0, 0, 0, 0]).explode("tags")
    assert s.columns == ["id", "tags", "z"]
    assert multiset((r["id"], r["tags"]) for r in rows(s)) == multiset([(1, "a"), (1, "b"), (3, "c"), (3, None)])


def test_union(spark):
    a, b = make(spark, id=[1, 2], v=["a", "b"]), make(spark, id=[2, 3], v=["b", "c"])
    assert multiset((r["id"], r["v"]) for r in rows(a.union(b))) == multiset([(1, "a"), (2, "b"), (2, "b"), (3, "c")])
    assert len(rows(a.union(b, a))) == 6
    narrow = source(pa.table({"id": pa.array([1], pa.int32()), "v": ["x"]}), spark)
    with pytest.raises(TypeError):
        a.union(narrow)
    tagged = source(pa.table({"id": [9], "v": ["z"]}).replace_schema_metadata({"a": "b"}), spark)
    assert len(rows(a.union(tagged))) == 3


def test_empty_input(spark):
    s = source(pa.table({"k": pa.array([], pa.int64()), "v": pa.array([], pa.float64())}), spark)
    assert rows(s.agg_by("k", s=("v", "sum"))) == []
    assert rows(s.count_by("k")) == []


def test_partitions_do_not_change_results(spark):
    rng = random.Random(1)
    s = make(spark, k=[rng.randrange(20) for _ in range(500)], v=list(range(500))).agg_by("k", s=("v", "sum"), c=("v", "count"))
    want = multiset(rows(s))
    for n in (1, 3, 8):
        assert multiset(s.collect(parallelism=n)) == want
    with pytest.raises(ValueError):
        s.run(parallelism=0)
    with pytest.raises(ValueError):
        s.run(parallelism=4, key_groups=2)


def test_native_verbs_plan_without_python(spark, small):
    s = source(f"{small}/documents.parquet", spark).tokenize("text").count_by("word")
    plan = s.df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<text:string>" in plan


def test_ieee_division(spark):
    from rillworks.functions.exprs import ieee_div

    s = make(spark, a=[1.0, -1.0, 0.0, None, 6.0], b=[0.0, 0.0, 0.0, 1.0, 3.0]).with_column("q", ieee_div(F.col("a"), F.col("b")))
    got = [r["q"] for r in rows(s)]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] is None and got[4] == 2


def test_rebalance_and_write(spark, tmp_path):
    s = make(spark, k=["a", "b", "a"], v=[1, 2, 3])
    assert len(rows(s.rebalance())) == 3 and s.rebalance(2).df.rdd.getNumPartitions() == 2
    s.write(str(tmp_path / "out"), partition_by=["k"])
    back = source(str(tmp_path / "out"), spark)
    assert multiset(rows(back.select("k", "v"))) == multiset(rows(s))
    s.write(str(tmp_path / "csv"), format="csv", header=True)
    again = source(str(tmp_path / "csv"), spark, format="csv", header=True, inferSchema=True)
    assert sum(r["v"] for r in rows(again)) == 6


def test_steps_are_kept(spark):
    s = make(spark, k=["a"], v=[1]).filter(F.col("v") > 0).count_by("k")
    assert s.lineage() == ("source", "filter", "count_by k")
