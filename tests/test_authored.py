"""Authored operators, async stages, sinks, sources, tensors and reports."""

from __future__ import annotations

import asyncio
import json
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tests.conftest import multiset

from rillworks import run, source, tensors
from rillworks.cli import main
from rillworks.measure import Timing, chance_of_ranks, regressed
from rillworks.operators.author import (
    AsyncOneInputOperator,
    AsyncSink,
    Collector,
    KeyContext,
    OneInputOperator,
    OperatorContext,
    SourceOperator,
    StateAccessError,
    TwoInputOperator,
)
from rillworks.operators.sinks import UpsertSink
from rillworks.plans import catalogue, pipelines
from rillworks.report import value_hash
from rillworks.sources import connector, synthetic, zarr


def ids(spark, n=100, parts=4):
    return source(spark.range(0, n, 1, parts))


def test_map_arrow_learns_its_schema(spark):
    fn = lambda b: pa.RecordBatch.from_arrays([pa.array([x * 2 for x in b.column(0).to_pylist()], pa.int64())], ["twice"])
    s = ids(spark).map_arrow(fn)
    assert s.df.dtypes == [("twice", "bigint")]
    assert sum(r["twice"] for r in s.collect()) == 9900


def test_flat_map(spark):
    s = source(pa.table({"id": [1, 2, 3], "reps": [2, 0, 1]}), spark).flat_map(
        lambda r: [{"id": r["id"], "i": i} for i in range(r["reps"])], "id long, i long"
    )
    assert multiset((r["id"], r["i"]) for r in s.collect()) == multiset([(1, 0), (1, 1), (3, 0)])


def test_operator_keeps_keys_together(spark):
    rows = spark.range(1000).select(F.pmod("id", F.lit(7)).alias("k"), F.col("id").alias("v"))

    class Totals(catalogue.CountAndSum):
        def on_eos(self, out):
            made = [(k.key, n, t) for k, (n, t) in self.ctx.entries("totals")]
            out.emit(pa.RecordBatch.from_pylist([dict(zip("knt", r)) for r in made], pa.schema([(c, pa.int64()) for c in "knt"])))

    for parallelism in (1, 3, None):
        got = source(rows).apply(Totals, "k long, n long, t long", key_columns=["k"], parallelism=parallelism).collect()
        assert multiset((r["k"], r["t"]) for r in got) == multiset((k, sum(range(k, 1000, 7))) for k in range(7))


def test_upserts_keep_the_last_row(spark, tmp_path):
    for value in (1, 2):
        rows = spark.createDataFrame([("a/b", value), ("c", value)], "item_id string, v int")
        source(rows).sink(lambda: UpsertSink(str(tmp_path))).run()
    assert {f.name: json.loads(f.read_text())["v"] for f in tmp_path.iterdir()} == {"a%2Fb.json": 2, "c.json": 2}


def test_context_state():
    ctx = OperatorContext()
    state = ctx.reducing_state("s", KeyContext("a"), lambda x, y: x + y)
    state.add(1)
    state.add(2)
    ctx.reduce_all("s", [("a", 3), ("b", 5)], lambda x, y: x + y)
    assert {k.key: v for k, v in ctx.entries("s")} == {"a": 6, "b": 5}
    saved = ctx.snapshot()
    ctx.clear_state("s", KeyContext("a"))
    assert state.get() is None
    ctx.restore(saved)
    assert state.get() == 6
    value = ctx.value_state("v", KeyContext("a", "ns"))
    value.update(9)
    assert value.value() == 9
    value.clear()
    assert value.value() is None


@pytest.mark.parametrize("ordered", [True, False])
def test_map_async_overlaps(spark, ordered):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:

        async def wait(batch):
            await asyncio.sleep(0.05 if batch.column(0)[0].as_py() % 20 else 0.1)
            return batch

        s = source(spark.range(0, 200, 1, 1)).map_async(wait, max_in_flight=10, ordered=ordered)
        began = time.perf_counter()
        got = [r["id"] for r in s.collect()]
        assert time.perf_counter() - began < 5
        assert sorted(got) == list(range(200))
        if ordered:
            assert got == list(range(200))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_async_failure_fails_the_run(spark):
    async def bad(batch):
        raise RuntimeError("no such host")

    with pytest.raises(Exception, match="no such host"):
        ids(spark).map_async(bad).run()
    with pytest.raises(ValueError):
        ids(spark).map_async(bad, max_in_flight=0)


class Echo(AsyncOneInputOperator):
    limit, keyed_unordered, touch = None, False, False

    def open(self, ctx):
        self.ctx = ctx

    async def fetch(self, batch):
        if self.touch:
            self.ctx.value_state("x", KeyContext(1)).value()
        await asyncio.sleep(0.2 if self.limit else 0)
        return batch.num_rows

    def integrate(self, batch, result, ctx, out):
        ctx.value_state("n", KeyContext(0)).update(result)
        out.emit(batch)

    def timeout_micros(self):
        return self.limit

    def ordered(self):
        return not self.keyed_unordered


class Slow(Echo):
    limit = 1000


class Touches(Echo):
    touch = True


class Unordered(Echo):
    keyed_unordered = True


def test_apply_async(spark):
    assert len(ids(spark).apply_async(Echo, "id long").collect()) == 100
    with pytest.raises(Exception, match="Timeout"):
        ids(spark).apply_async(Slow, "id long").run()
    assert len(ids(spark).apply_async(Echo, "id long", key_columns=["id"]).collect()) == 100
    with pytest.raises(Exception, match=StateAccessError.__name__):
        ids(spark).apply_async(Touches, "id long").run()
    with pytest.raises(ValueError):
        ids(spark).apply_async(Unordered, "id long", key_columns=["id"])


def test_sink_writes_every_row(spark, tmp_path):
    class Files(AsyncSink):
        async def write(self, batch):
            if batch.num_rows:
                name = f"{batch.column(0)[0].as_py()}.json"
                (tmp_path / name).write_text(json.dumps(batch.column(0).to_pylist()))

    result = ids(spark).sink(Files).run()
    assert len(result) == 0 and result.report.rows_out == 100
    assert sorted(i for f in tmp_path.iterdir() for i in json.loads(f.read_text())) == list(range(100))


def test_sources(spark):
    assert source(pa.record_batch({"a": [1]}), spark).collect() == [{"a": 1}]
    assert len(source([pa.record_batch({"a": [1]}), pa.record_batch({"a": [2]})], spark).collect()) == 2
    wide = source(pa.table({"u": pa.array([2**63], pa.uint64()), "b": pa.array([200], pa.uint8())}), spark)
    assert dict(wide.df.dtypes) == {"u": "decimal(20,0)", "b": "smallint"}
    assert source(pa.table({"d": pa.array(["x", "y", "x"]).dictionary_encode()}), spark).count_by("d").df.count() == 2
    assert len(source(catalogue.Squares, spark).collect()) == 1000
    with pytest.raises(TypeError):
        source(5, spark)


def test_skewed_source_is_skewed_and_nulls_come(spark):
    counts = {r["key"]: r["count"] for r in source(synthetic.keyed(spark, 20_000, 100, skew=1.5, null_fraction=0.1)).count_by("key").collect()}
    assert max(v for k, v in counts.items() if k is not None) > 5 * 20_000 / 100
    assert 1500 < counts[None] < 2500
    wide = synthetic.keyed(spark, 10, 3, payload_bytes=4, extra_values=2)
    assert wide.columns == ["key", "value", "ts", "payload", "v0", "v1"]


def test_tensors(spark):
    images = np.arange(2 * 2 * 3 * 4, dtype=np.uint8).reshape(2, 2, 3, 4)
    array = tensors.tensor_array(images)
    assert (tensors.to_numpy(array) == images).all()
    assert tensors.embedding_array(np.ones((3, 5))).type.shape == [5]
    assert (tensors.to_numpy(tensors.tensor_from_rows([images[0], images[1]])) == images).all()
    for bad in (lambda: tensors.tensor_array(np.ones(3)), lambda: tensors.embedding_array(np.ones((2, 2, 2))), lambda: tensors.tensor_from_rows([images[0], images[0][:1]])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        tensors.to_numpy(pa.array([1]))
    df = source(pa.table({"i": [0, 1], "t": pa.chunked_array([array])}), spark).df
    assert tensors.shape_of(df.where("i = 1").select("t"), "t") == (2, 3, 4)
    assert df.orderBy("i").first().t == images[0].reshape(-1).tolist()
    again = tensors.reattach(df.groupBy("i").agg(F.first("t").alias("t")), "t", (2, 3, 4))
    assert tensors.shape_of(again, "t") == (2, 3, 4)


def test_image_embed(spark):
    images = np.random.default_rng(0).integers(0, 256, (7, 8, 8, 3), dtype=np.uint8)
    got = {r["tile_id"]: r["embedding"] for r in pipelines.image_embed(spark).collect()}
    for i in range(7):
        assert np.allclose(got[i], images[i].mean(axis=(0, 1)), atol=1e-3)


def test_scene_means_with_an_injected_reader(spark):
    scenes = {"r1": np.full((4, 4), 1), "n1": np.full((4, 4), 3), "r2": np.zeros((4, 4)), "n2": np.zeros((4, 4))}
    got = {r["item_id"]: r for r in pipelines.scene_means(spark, [("a", "r1", "n1"), ("b", "r2", "n2")], scenes.__getitem__).collect()}
    assert got["a"]["mean_ndvi"] == 0.5 and got["a"]["valid_count"] == 16
    assert np.isnan(got["b"]["mean_ndvi"])


SMALL_SIZES = {"demo-stream": {"interval": 0.0}, "bench-fanout": {"rows": 8, "tokens": 20}, "bench-backpressure": {"rows": 100, "micros": 10}, "bench-async-io": {"rows": 100}}


@pytest.mark.parametrize("name", list(pipelines.PIPELINES))
def test_every_pipeline_runs(spark, name):
    options = SMALL_SIZES.get(name) or ({"days": 1} if "geo" in name else {"rows": 1000} if name.startswith("bench") else {})
    df = pipelines.PIPELINES[name](spark, **options).df
    assert df.limit(3).count() > 0


def test_anomalies_add_up_to_nothing(spark):
    total = pipelines.geo_anomaly(spark, 2).df.agg(F.sum("anomaly")).first()[0]
    assert abs(total) < 1e-6


def test_results_and_reports(spark):
    result = run(spark.range(10), [lambda s: s.filter(F.col("id") > 4), lambda s: s.rename({"id": "n"})])
    assert result.to_pydict()["n"] == [5, 6, 7, 8, 9]
    assert sum(b.num_rows for b in result) == 5
    with pytest.raises(TypeError):
        result[0:1]
    again = run(spark.range(10).repartition(3), [lambda s: s.filter(F.col("id") > 4), lambda s: s.rename({"id": "n"})])
    assert result.report.structural_digest() == again.report.structural_digest()
    assert json.loads(result.report.to_json())["rows_out"] == 5 and "5 rows" in result.report.to_markdown()
    assert value_hash(spark.range(10)) == value_hash(spark.range(10).repartition(4)) != value_hash(spark.range(11))
    assert asyncio.run(source(spark.range(3)).run_async()).to_pydict() == {"id": [0, 1, 2]}


def test_command_line(spark, capsys):
    assert main(["version"]) == 0
    assert main(["examples"]) == 0
    assert main(["run", "wordcount", "--report", "json"]) == 0
    assert main(["run", "rillworks.plans.pipelines:wordcount", "--rows", "1"]) == 0
    out = capsys.readouterr().out
    assert "bench-keyed" in out and "'word'" in out
    with pytest.raises(SystemExit):
        main(["run", "nothing"])


def test_timings(tmp_path, capsys):
    of = lambda *seconds: Timing("a", seconds, 100)
    old = of(1.0, 1.01, 0.99, 1.0)
    assert regressed(of(1.3, 1.3, 1.3, 1.3), old) and not regressed(old, old)
    assert not regressed(of(1.02, 1.03, 1.02, 1.03), old)  # slower for sure, but by nothing
    assert not regressed(of(0.9, 1.3, 0.9, 1.3), old)  # slower by much, but by chance
    assert chance_of_ranks((3.0, 4.0), (1.0, 2.0)) == 1 / 6 and chance_of_ranks((1.0,), (1.0,)) == 1
    assert chance_of_ranks(tuple(range(20, 40)), tuple(range(20))) < 1e-6 < 0.4 < chance_of_ranks(tuple(range(20)), tuple(range(20)))
    assert old.rows_per_second == 100
    for name, seconds in (("old", old.seconds), ("new", (1.3, 1.3, 1.3, 1.3))):
        (tmp_path / name).write_text(json.dumps({"a": seconds, name: seconds}))
    assert main(["bench-check", str(tmp_path / "old"), str(tmp_path / "new")]) == 1
    assert main(["bench-check", str(tmp_path / "old"), str(tmp_path / "old")]) == 0
    assert "slower" in capsys.readouterr().out
    assert main(["catalog"]) == 0 and "wordcount\tSQL" in capsys.readouterr().out


def test_verbs_operators_and_counters_in_the_report(spark):
    class Evens(OneInputOperator):
        def open(self, ctx):
            self.ctx = ctx

        def process(self, batch, out):
            self.ctx.metrics.incr("seen", batch.num_rows)
            out.emit(batch.filter(pa.array([v % 2 == 0 for v in batch.column(0).to_pylist()])))

    left = ids(spark).counted().filter(F.col("id") < 60).apply(Evens, "id long")
    stream = left.union(ids(spark, 10).counted()).map(lambda df: df.select((F.col("id") % 3).alias("k"))).count_by("k")
    assert stream.to_graph() == {
        "nodes": [{"id": i, "step": s} for i, s in enumerate(["source", "filter", "apply", "source", "union 2", "map", "count_by k"])],
        "edges": [[0, 1], [1, 2], [2, 4], [3, 4], [4, 5], [5, 6]],
    }
    result = stream.run()
    rows = {v["step"]: (v["rows_in"], v["rows_out"]) for v in result.report.verbs}
    assert rows["filter"] == (100, 60) and rows["apply"] == (60, 30) and rows["union 2"] == (40, 40) and rows["count_by k"] == (40, 3)
    assert result.report.metrics == {"Evens.seen": 60}
    assert [x["rows_out"] for x in result.report.operator("HashAggregate")][-1] == 3
    assert "| filter | 100 | 60 |" in result.report.to_markdown()
    plain = ids(spark).filter(F.col("id") < 60).run()
    assert plain.report.verbs == [] and plain.report.operator("Filter") + plain.report.operator("Range")
    assert ids(spark).apply(Evens, "id long").profile().metrics == {"Evens.seen": 100}


def test_two_inputs_pass_through_in_batches(spark):
    class Sizes(TwoInputOperator):
        def open(self, ctx):
            self.ctx, self.rows, self.batches, self.right = ctx, [0, 0], 0, False

        def process_left(self, batch, out):
            assert not self.right and batch.schema.names == ["k", "v"]
            self.key, self.rows[0], self.batches = batch.column(0)[0].as_py(), self.rows[0] + batch.num_rows, self.batches + 1
            assert len({repr(k) for k in batch.column(0).to_pylist()}) == 1

        def process_right(self, batch, out):
            self.key, self.rows[1], self.right = batch.column(0)[0].as_py(), self.rows[1] + batch.num_rows, True

        def on_eos(self, out):
            self.ctx.metrics.incr("keys")
            out.emit(pa.RecordBatch.from_pylist([{"k": self.key, "a": self.rows[0], "b": self.rows[1], "n": self.batches}], pa.schema([("k", pa.float64()), *((c, pa.int64()) for c in "abn")])))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        hot = spark.range(1000).select(F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 == 1, float("nan")).otherwise(F.lit(7.0)).alias("k"), F.col("id").alias("v"))
        few = spark.createDataFrame([(7.0, 1), (8.0, 1), (None, 2), (8.0, 3)], "k double, w long")
        result = source(hot).apply_two(source(few), Sizes, "k double, a long, b long, n long", left_keys=["k"], right_keys=["k"]).run()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {repr(r["k"]): (r["a"], r["b"]) for r in result.to_pylist()}
    assert got == {"None": (200, 1), "nan": (200, 0), "7.0": (600, 1), "8.0": (0, 2)}
    assert max(r["n"] for r in result.to_pylist()) > 5  # the hot key came in many batches
    assert result.report.metrics == {"Sizes.keys": 4}


def test_arrow_masks_and_columns(spark):
    rows = source(pa.table({"a": [1, None, 3], "b": ["x", "y", "z"]}), spark)
    assert [r["b"] for r in rows.filter_arrow(lambda b: pc.greater(b["a"], 1)).collect()] == ["z"]
    made = rows.with_column_arrow("a", lambda b: pc.cast(b["a"], pa.string())).with_column_arrow("c", lambda b: pc.utf8_upper(b["b"]))
    assert made.df.dtypes == [("a", "string"), ("b", "string"), ("c", "string")]
    assert [r["c"] for r in made.collect()] == ["X", "Y", "Z"]


def test_chunks_wait_in_a_window(spark):
    async def read(i):
        running = read.__dict__
        running["now"] = running.get("now", 0) + 1
        running["most"] = max(running.get("most", 0), running["now"])
        await asyncio.sleep(0.001)
        running["now"] -= 1
        return pa.table({"i": [i], "most": [running["most"]]})

    got = connector.chunks(spark, list(range(40)), read, "i long, most long", 3, partitions=2).collect()
    assert sorted(r.i for r in got) == list(range(40)) and max(r.most for r in got) <= 3
    assert connector.chunks(spark, [], read, "i long, most long").count() == 0


def test_splits_travel_to_their_tasks(spark):
    class Moody(SourceOperator):
        schema = "i long"

        def partitions(self):
            import random

            return random.sample(range(100), 10)

        def batches(self, partition):
            yield pa.RecordBatch.from_pydict({"i": [partition]})

    assert len({r["i"] for r in source(Moody, spark).collect()}) == 10


def test_zarr_arrays(spark, tmp_path):
    data = np.arange(7 * 5 * 4, dtype=np.float32).reshape(7, 5, 4)
    for packing in (None, "zlib", "gzip", "zstd"):
        zarr.write(str(tmp_path / f"{packing}" / "v"), data, (3, 2, 4), packing)
        array = zarr.ZarrArray(str(tmp_path / f"{packing}" / "v"))
        for selection in ((), (2,), (slice(1, 6), 3), (-1, slice(None), slice(1, 3)), (slice(4, 4),)):
            assert (array.read(selection) == data[selection]).all() and array.read(selection).shape == data[selection].shape
    (tmp_path / "zlib" / "v" / "0.0.0").unlink()
    assert (zarr.ZarrArray(str(tmp_path / "zlib" / "v")).read()[:3, :2] == 0).all()
    with pytest.raises(IndexError):
        array.read((7,))
    with pytest.raises(ValueError):
        array.read((slice(0, 4, 2),))
    columns = lambda i, a: {"i": np.full(a.size, i), "v": a.reshape(-1)}
    named = spark.range(7).select(F.col("id").alias("chunk_idx"))
    got = zarr.read_chunks(named, str(tmp_path / "zstd"), "v", columns, "i long, v float").collect()
    assert multiset((r.i, r.v) for r in got) == multiset((i, float(v)) for i in range(7) for v in data[i].reshape(-1))


def test_zipf_table_is_the_law():
    for keys, skew in ((1, 1.5), (7, 0.5), (500, 1.5), (5000, 1.1)):
        share, other = synthetic.zipf_table(keys, skew)
        mass = np.zeros(keys)
        for i, (s, o) in enumerate(zip(share, other)):
            mass[i] += s
            mass[o] += 1 - s
        law = np.arange(1, keys + 1) ** -skew
        assert np.allclose(mass / keys, law / law.sum())


def test_large_zipf_tables_are_joined(spark):
    few, many = (synthetic.keyed(spark, 3000, 5000, skew=1.2) for _ in range(2))
    assert many.where("key = 0").count() > 300 and few.count() == 3000
    small = synthetic.keyed(spark, 3000, 400, skew=1.2).select("key").collect()
    assert small == synthetic.keyed(spark, 3000, 400, skew=1.2, partitions=7).select("key").collect()


def test_collector_drains():
    out = Collector()
    out.emit(pa.record_batch({"a": [1]}))
    assert len(out.drain()) == 1 and out.drain() == []
    assert OneInputOperator.key_columns(None) is None
