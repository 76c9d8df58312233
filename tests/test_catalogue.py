"""Every catalogued query against DuckDB over the small tables, and live against batch."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tests.conftest import multiset

import __spark_entry__ as entry_points
from rillworks.plans.catalogue import ORACLES, QUERIES
from rillworks.stream import Stream
from rillworks.streaming import run as live

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return [plain(v) for v in value] if isinstance(value, list) else value


def rows_of(table):
    names = sorted(table.column_names)
    return names, multiset(tuple(plain(v) for v in row) for row in zip(*[table.column(n).to_pylist() for n in names]))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path("/root/testdata/sf0.001") / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, small, duck, name):
    got = QUERIES[name](spark, small).toArrow()
    if name in ORACLES:
        assert rows_of(got) == rows_of(duck.sql(ORACLES[name]).to_arrow_table())
    else:
        assert got.num_rows > 0


def test_image_embed_on_odd_vectors(spark, tmp_path):
    """To the bit: signs of zero, ties and almost ties of the rounding, nulls, short vectors, what is not finite."""
    nan, inf = float("nan"), float("inf")

    def eight(mean):
        """Floats whose exact mean is a double that no float holds."""
        parts = []
        for _ in range(8):
            parts.append(float(np.float32(8 * mean - sum(parts))))
        assert sum(parts) == 8 * mean
        return parts

    ties = [k / 128 for k in (1, -1, 3, -3, 5, -5, 127, -129) for _ in range(8)]
    almost = [x for mean in (2.4999999999999998e-06, 0.0001245) for sign in (1, -1) for x in eight(sign * mean)] * 2
    rows = [
        [-1e-7] * 64, [-0.0] * 64, [1e-7] * 64, ties, almost,
        [None] * 8 + [1.0, None, 2.0] + [3.0] * 53, [float(i) for i in range(12)], [0.1] * 80, [], None,
        [nan] + [1.0] * 63, [inf, -inf] + [1.0] * 6 + [inf] * 8 + [-inf] * 48, [3e38] * 64,
    ]
    path = tmp_path / "embeddings.parquet"
    pq.write_table(pa.table({"vec_id": range(len(rows)), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": [0] * len(rows)}), path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    got = {r.vec_id: repr(list(r.pooled)) for r in QUERIES["image_embed"](spark, str(tmp_path)).collect()}
    assert got == {k: repr(pooled) for k, pooled in con.sql(ORACLES["image_embed"]).fetchall()}


def test_entry_points(spark, small):
    assert entry_points.entry(spark).limit(1).count() == 1
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_live_windows_and_outer_join_rule(spark, small):
    path = f"{small}/events.parque[t]"
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    events = live.read_stream(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = live.available_now(live.windowed_count(events, "ts", "event_type", "1 day", "1 day"), "complete")
    assert counted.agg(F.sum("count")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()
    a, b = Stream(events.select("user_id")), Stream(events.select("user_id"))
    with pytest.raises(ValueError):
        a.join(b, on="user_id", how="left")


def test_live_writers(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    events = live.read_stream(spark, f"{small}/events.parque[t]", schema, max_files=1)
    live.write_stream(events, str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == spark.read.parquet(f"{small}/events.parquet").count()
    live.upsert_totals(Stream(events).count_by("event_type").df, str(tmp_path / "totals"))
    assert spark.read.parquet(str(tmp_path / "totals")).count() > 0
