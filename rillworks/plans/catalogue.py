"""The named queries over the provided tables, and the SQL each must agree with."""

from __future__ import annotations

import asyncio
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.functions import exprs
from rillworks.operators import joins
from rillworks.operators.author import AsyncOneInputOperator, KeyContext, OneInputOperator, SourceOperator, TwoInputOperator
from rillworks.operators.sinks import ParquetSink, UpsertSink
from rillworks.plans import pipelines
from rillworks.sources import connector, synthetic, zarr
from rillworks.stream import Stream, source
from rillworks.streaming import run as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL it must agree with."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def at(spark: SparkSession, sf_dir: str, name: str) -> Stream:
    return source(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# tokenize and count_by

_SPACES = "".join(f"\\x{{{c:x}}}" for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_WORDS = "SELECT unnest(regexp_split_to_array(TEXT, '[\\t-\\r\\x1c-\\x20" + _SPACES + "]+')) AS word FROM documents"


@query(f"SELECT word, count(*) AS count FROM ({_WORDS.replace('TEXT', 'lower(text)')}) WHERE word <> '' GROUP BY word")
def wordcount(spark, d):
    return at(spark, d, "documents").select("text").spread().tokenize("text").count_by("word").df


@query(f"SELECT word, count(*) AS count FROM ({_WORDS.replace('TEXT', 'text')}) WHERE word <> '' GROUP BY word")
def tokenize_case(spark, d):
    return at(spark, d, "documents").select("text").spread().tokenize("text", lowercase=False).count_by("word").df


@query(f"SELECT word FROM ({_WORDS.replace('TEXT', 'lower(text)')}) WHERE word <> ''")
def tokenize(spark, d):
    return at(spark, d, "documents").select("text").spread().tokenize("text").df


@query("SELECT l_returnflag, count(*) AS count FROM lineitem GROUP BY 1")
def count_by_string(spark, d):
    return at(spark, d, "lineitem").count_by("l_returnflag").df


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def count_by_int(spark, d):
    return at(spark, d, "orders").count_by("o_custkey", "n").df


@query("SELECT CAST(nullif(c_nationkey % 5, 0) AS INTEGER) AS k, count(*) AS count FROM customer GROUP BY 1")
def count_by_null_key(spark, d):
    key = F.nullif(F.col("c_nationkey") % 5, F.lit(0)).cast("int")
    return at(spark, d, "customer").with_column("k", key).count_by("k").df


# agg_by

#: Means are scaled before they are rounded: engines differ in rounding exact halves, and a scaled mean isn't one.
_SCALE = 0.7310585786300049
_FIVE = "round(sum({v}), 4) AS s, count({v}) AS c, round(avg({v}) * 0.7310585786300049, 4) AS m, min({v}) AS lo, max({v}) AS hi"


def _five(stream: Stream, keys, v: str) -> DataFrame:
    out = stream.agg_by(keys, s=(v, "sum"), c=(v, "count"), m=(v, "mean"), lo=(v, "min"), hi=(v, "max"))
    return out.with_column("s", F.round("s", 4)).with_column("m", F.round(F.col("m") * _SCALE, 4)).df


@query(f"SELECT l_suppkey, {_FIVE.format(v='l_extendedprice')} FROM lineitem GROUP BY 1")
def agg_by_single_int(spark, d):
    return _five(at(spark, d, "lineitem"), "l_suppkey", "l_extendedprice")


@query(f"SELECT l_returnflag, {_FIVE.format(v='l_quantity')} FROM lineitem GROUP BY 1")
def agg_by_string(spark, d):
    return _five(at(spark, d, "lineitem"), "l_returnflag", "l_quantity")


@query(f"SELECT l_returnflag, l_linestatus, {_FIVE.format(v='l_discount')} FROM lineitem GROUP BY 1, 2")
def agg_by_composite(spark, d):
    return _five(at(spark, d, "lineitem"), ("l_returnflag", "l_linestatus"), "l_discount")


@query(
    "SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS s, count(l_linenumber) AS c, avg(l_linenumber) AS m,"
    " CAST(min(l_linenumber) AS BIGINT) AS lo, CAST(max(l_linenumber) AS BIGINT) AS hi FROM lineitem GROUP BY 1"
)
def agg_by_int_values(spark, d):
    v = "l_linenumber"
    out = at(spark, d, "lineitem").agg_by("l_suppkey", s=(v, "sum"), c=(v, "count"), m=(v, "mean"), lo=(v, "min"), hi=(v, "max"))
    return out.df


@query("SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, count(n_name) AS c, min(n_name) AS lo, max(n_name) AS hi FROM nation GROUP BY 1")
def agg_by_int32_key_strings(spark, d):
    return at(spark, d, "nation").agg_by("n_regionkey", c=("n_name", "count"), lo=("n_name", "min"), hi=("n_name", "max")).df


@query(
    f"SELECT l_suppkey, {_FIVE.format(v='v')} FROM (SELECT l_suppkey, CASE WHEN l_linenumber > 1 THEN l_quantity END AS v FROM lineitem) GROUP BY 1"
)
def agg_by_null_values(spark, d):
    rows = at(spark, d, "lineitem").with_column("v", F.when(F.col("l_linenumber") > 1, F.col("l_quantity")))
    return _five(rows, "l_suppkey", "v")


@query(
    f"SELECT l_returnflag, {_FIVE.format(v='v')} FROM (SELECT l_returnflag, CASE WHEN l_returnflag <> 'R' THEN l_tax END AS v FROM lineitem) GROUP BY 1"
)
def agg_by_all_null_group(spark, d):
    rows = at(spark, d, "lineitem").with_column("v", F.when(F.col("l_returnflag") != "R", F.col("l_tax")))
    return _five(rows, "l_returnflag", "v")


@query(
    "SELECT k, CAST(sum(c_custkey) AS BIGINT) AS s FROM (SELECT nullif(c_custkey % 7, 0) AS k, c_custkey FROM customer) GROUP BY 1"
)
def agg_by_null_key(spark, d):
    rows = at(spark, d, "customer").with_column("k", F.nullif(F.col("c_custkey") % 7, F.lit(0)))
    return rows.agg_by("k", s=("c_custkey", "sum")).df


@query("SELECT l_partkey, avg(l_quantity) AS mean, count(l_quantity) AS n FROM lineitem GROUP BY 1")
def keyed_mean(spark, d):
    return at(spark, d, "lineitem").keyed_mean("l_partkey", "l_quantity").df


@query(
    "SELECT l_partkey, round(sum(l_extendedprice * l_quantity) / sum(CAST(l_quantity AS BIGINT)), 4) AS mean,"
    " CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1"
)
def weighted_mean(spark, d):
    rows = at(spark, d, "lineitem").with_column("t", F.col("l_extendedprice") * F.col("l_quantity")).with_column("q", F.col("l_quantity").cast("long"))
    return rows.weighted_mean("l_partkey", "t", "q").with_column("mean", F.round("mean", 4)).df


# projections and row transforms


@query("SELECT * FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def filter_rows(spark, d):
    return at(spark, d, "lineitem").filter((F.col("l_quantity") > 30) & (F.col("l_returnflag") == "R")).df


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') <> 'F'")
def filter_null_mask(spark, d):
    return at(spark, d, "orders").filter(F.nullif(F.col("o_orderstatus"), F.lit("P")) != "F").select("o_orderkey").df


@query("SELECT p_size, p_name FROM part")
def select(spark, d):
    return at(spark, d, "part").select("p_size", "p_name").df


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def drop(spark, d):
    return at(spark, d, "customer").drop("c_name", "c_mktsegment").df


@query("SELECT s_suppkey AS id, s_name AS name, s_nationkey, s_acctbal FROM supplier")
def rename(spark, d):
    return at(spark, d, "supplier").rename({"s_suppkey": "id", "s_name": "name"}).df


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def with_column_add(spark, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return at(spark, d, "lineitem").with_column("net", net).select("l_orderkey", "l_linenumber", "net").df


@query("SELECT p_partkey, p_name, upper(p_brand) AS p_brand, p_type, p_size, p_retailprice FROM part")
def with_column_replace(spark, d):
    return at(spark, d, "part").with_column("p_brand", F.upper("p_brand")).df


@query("SELECT l_orderkey, l_linenumber, (l_extendedprice - l_quantity) / (l_extendedprice + l_quantity) AS ndvi FROM lineitem")
def map_ndvi_like(spark, d):
    index = exprs.ndvi(F.col("l_extendedprice"), F.col("l_quantity")).alias("ndvi")
    return at(spark, d, "lineitem").map(lambda df: df.select("l_orderkey", "l_linenumber", index)).df


@query("SELECT event_id, value * 2 AS doubled FROM events")
def map_arrow(spark, d):
    def double(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pc.multiply(batch.column(1), 2.0)], ["event_id", "doubled"])

    return at(spark, d, "events").select("event_id", "value").map_arrow(double).df


@query("SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
def explode_embedding(spark, d):
    return at(spark, d, "embeddings").select("vec_id", "embedding").explode("embedding").df


@query("SELECT vec_id, unnest(list_filter(embedding, lambda x: x > 0.3125)) AS embedding FROM embeddings")
def explode_drop_empty(spark, d):
    """Lists that are empty, and with small labels null, give no row."""
    large = F.filter("embedding", lambda x: x > 0.3125)
    some = F.when((F.size(large) > 0) | (F.col("label") > 4), large)
    return at(spark, d, "embeddings").with_column("embedding", some).select("vec_id", "embedding").explode("embedding").df


@query("SELECT l_orderkey, unnest(range(l_linenumber)) AS i FROM lineitem")
def flat_map_expand(spark, d):
    rows = at(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return rows.flat_map(lambda r: [{"l_orderkey": r["l_orderkey"], "i": i} for i in range(r["l_linenumber"])], "l_orderkey long, i long").df


# joins

#: Whole tables; customers are moved by 37 numbers, so that both sides have rows without a partner.
_SIDES = "orders o {how} JOIN (SELECT c_custkey + 37 AS c_custkey, c_name FROM customer) c ON o.o_custkey = c.c_custkey"


def _sides(spark, d) -> tuple[Stream, Stream]:
    orders = at(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = at(spark, d, "customer").select("c_custkey", "c_name").with_column("c_custkey", F.col("c_custkey") + 37)
    return orders, customers


def _join(how: str) -> None:
    def run(spark, d):
        orders, customers = _sides(spark, d)
        return orders.join(customers, left_on="o_custkey", right_on="c_custkey", how=how).df

    run.__name__ = f"join_{how}"
    sql = {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "outer": "FULL"}[how]
    key = "o_custkey" if how in ("inner", "left") else "coalesce(o_custkey, c_custkey) AS o_custkey"
    query(f"SELECT o_orderkey, {key}, o_totalprice, c_name FROM {_SIDES.format(how=sql)}")(run)


for _how in ("inner", "left", "right", "outer"):
    _join(_how)

_NULL_SIDE = "(SELECT nullif({k} % 7, 0) + {more} AS k, count(*) AS {n} FROM {t} GROUP BY 1)"


def _null_join(how: str) -> None:
    def run(spark, d):
        key = lambda k, more: F.nullif(F.col(k) % 7, F.lit(0)) + more
        side = lambda t, k, n, more: at(spark, d, t).with_column("k", key(k, more)).count_by("k", n)
        return side("orders", "o_custkey", "a", 0).join(side("customer", "c_custkey", "b", 2), on="k", how=how).df

    run.__name__ = f"join_null_safe_{how}"
    sql = {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "outer": "FULL"}[how]
    a = _NULL_SIDE.format(k="o_custkey", n="a", t="orders", more=0)
    b = _NULL_SIDE.format(k="c_custkey", n="b", t="customer", more=2)
    query(f"SELECT coalesce(x.k, y.k) AS k, a, b FROM {a} x {sql} JOIN {b} y ON x.k IS NOT DISTINCT FROM y.k")(run)


for _how in ("inner", "left", "right", "outer"):
    _null_join(_how)


@query(
    "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_tax FROM lineitem a JOIN lineitem b"
    " ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"
)
def join_composite(spark, d):
    left = at(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    right = at(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return left.join(right, on=("l_orderkey", "l_linenumber")).df


@query("SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_diff_names(spark, d):
    nation = at(spark, d, "nation").select("n_nationkey", "n_name")
    return at(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(nation, left_on="s_nationkey", right_on="n_nationkey").df


@query("SELECT a.n_regionkey, a.n_name, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_cross_product(spark, d):
    left = at(spark, d, "nation").select("n_regionkey", "n_name")
    right = at(spark, d, "nation").select("n_regionkey", "n_name").rename({"n_name": "other"})
    return left.join(right, on="n_regionkey").df


@query(
    "SELECT s_suppkey, s_nationkey, n_name, n_regionkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"
    " JOIN region ON n_regionkey = r_regionkey"
)
def join_of_joins(spark, d):
    suppliers = at(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    placed = suppliers.join(at(spark, d, "nation"), left_on="s_nationkey", right_on="n_nationkey")
    return placed.join(at(spark, d, "region"), left_on="n_regionkey", right_on="r_regionkey").df


@query("SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = CAST(n_nationkey AS BIGINT)")
def join_width(spark, d):
    nation = at(spark, d, "nation").with_column("n_nationkey", F.col("n_nationkey").cast("long")).select("n_nationkey", "n_name")
    return at(spark, d, "customer").select("c_custkey", "c_nationkey").join(nation, left_on="c_nationkey", right_on="n_nationkey").df


@query("SELECT n_nationkey, n_name, r_name FROM nation, region WHERE false")
def join_typed_mismatch(spark, d):
    region = at(spark, d, "region").with_column("flag", F.col("r_regionkey") > 0).select("flag", "r_name")
    return at(spark, d, "nation").select("n_nationkey", "n_name").join(region, left_on="n_nationkey", right_on="flag").df


@query(
    "SELECT CAST(coalesce(s_nationkey, c_custkey) AS INTEGER) AS s_nationkey, s_suppkey, c_name FROM supplier"
    " FULL JOIN customer ON s_nationkey = c_custkey"
)
def join_outer_key_range(spark, d):
    """A 32-bit left key that takes unmatched 64-bit right keys; one it can't hold would fail."""
    customers = at(spark, d, "customer").select("c_custkey", "c_name")
    return at(spark, d, "supplier").select("s_nationkey", "s_suppkey").join(customers, left_on="s_nationkey", right_on="c_custkey", how="outer").df


# unions


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders")
def union_all(spark, d):
    rows = at(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return rows.filter(F.col("o_orderstatus") == "O").union(rows).df


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier")
def union_three(spark, d):
    named = lambda t, c: at(spark, d, t).select(c).rename({c: "name"})
    return named("nation", "n_name").union(named("region", "r_name"), named("supplier", "s_name")).df


# composed pipelines


@query("SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, round(avg(c_acctbal), 6) AS mean, count(c_acctbal) AS n FROM customer GROUP BY 1")
def zonal_mean(spark, d):
    return at(spark, d, "customer").keyed_mean("c_nationkey", "c_acctbal").with_column("mean", F.round("mean", 6)).df


_BANDS = [("low", -1000.0, 999.99), ("middle", 1000.0, 4999.99), ("high", 5000.0, 99999.0)]
_BAND_SQL = ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in _BANDS)
_ZONAL_SQL = (
    f"SELECT band, round(avg(c_acctbal), 6) AS mean, count(c_acctbal) AS n FROM customer JOIN (VALUES {_BAND_SQL}) b(band, lo, hi)"
    " ON c_acctbal BETWEEN lo AND hi GROUP BY 1"
)


@query(_ZONAL_SQL)
def zonal_vector(spark, d):
    bands = spark.createDataFrame(_BANDS, "band string, lo double, hi double")
    rows = at(spark, d, "customer").select("c_acctbal")
    tagged = rows.map(lambda df: joins.interval_join(df, bands, "c_acctbal", "lo", "hi", 500.0))
    return tagged.keyed_mean("band", "c_acctbal").with_column("mean", F.round("mean", 6)).df


@query(_ZONAL_SQL)
def zonal_vector_bucketed(spark, d):
    bands = spark.createDataFrame(_BANDS, "band string, lo double, hi double")
    rows = at(spark, d, "customer").select("c_acctbal")
    tagged = rows.map(lambda df: joins.bucket_join(df, bands, "c_acctbal", "lo", "hi", 500.0))
    return tagged.keyed_mean("band", "c_acctbal").with_column("mean", F.round("mean", 6)).df


@query(
    "SELECT user_id, event_type, CAST(hour(ts) AS BIGINT) AS h, round(avg(value), 6) AS clim, count(value) AS n FROM events GROUP BY 1, 2, 3"
)
def climatology(spark, d):
    rows = at(spark, d, "events").with_column("h", F.hour("ts"))
    return rows.agg_by(("user_id", "event_type", "h"), clim=("value", "mean"), n=("value", "count")).with_column("clim", F.round("clim", 6)).df


@query(
    "WITH clim AS (SELECT user_id, hour(ts) AS h, avg(value) AS clim FROM events GROUP BY 1, 2)"
    " SELECT event_id, e.user_id, CAST(hour(ts) AS BIGINT) AS h, value, round(clim, 6) AS clim, round(value - clim, 6) AS anomaly"
    " FROM events e JOIN clim c ON e.user_id = c.user_id AND hour(ts) = c.h"
)
def anomaly(spark, d):
    rows = at(spark, d, "events").with_column("h", F.hour("ts").cast("long")).select("event_id", "user_id", "h", "value")
    out = pipelines.anomaly(rows, ("user_id", "h"), "value")
    return out.with_column("clim", F.round("clim", 6)).with_column("anomaly", F.round("anomaly", 6)).df


@query(
    "WITH truth AS (SELECT l_partkey, avg(l_quantity) AS e FROM lineitem GROUP BY 1)"
    " SELECT l_returnflag, round(sqrt(avg(power(l_quantity - e, 2))), 6) AS rmse, count(*) AS n"
    " FROM lineitem JOIN truth USING (l_partkey) GROUP BY 1"
)
def forecast_rmse(spark, d):
    rows = at(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_quantity")
    scored = rows.join(rows.agg_by("l_partkey", e=("l_quantity", "mean")), on="l_partkey")
    scored = scored.with_column("se", exprs.squared_error(F.col("l_quantity"), F.col("e")))
    return scored.keyed_mean("l_returnflag", "se").map(lambda df: df.select("l_returnflag", F.round(F.sqrt("mean"), 6).alias("rmse"), "n")).df


@query(
    "SELECT vec_id, list_transform(range(8), lambda i: round(list_avg(list_transform(embedding[CAST(i * 8 + 1 AS BIGINT) : CAST(i * 8 + 8 AS BIGINT)],"
    " lambda x: CAST(x AS DOUBLE))), 6)) AS pooled FROM embeddings"
)
def image_embed(spark, d):
    pooled = F.transform(exprs.slice_means(F.col("embedding"), 8, 8), lambda x: exprs.rounded(x, 6))
    return at(spark, d, "embeddings").map(lambda df: df.select("vec_id", pooled.alias("pooled"))).df


@query(_ZONAL_SQL)
def zonal_vector_tags(spark, d):
    cases = [(name, F.col("c_acctbal").between(lo, hi)) for name, lo, hi in _BANDS]
    tagged = at(spark, d, "customer").select("c_acctbal").map(lambda df: joins.tags(df, "band", cases))
    return tagged.keyed_mean("band", "c_acctbal").with_column("mean", F.round("mean", 6)).df


# authored operators


@query("SELECT * FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def filter_arrow(spark, d):
    return at(spark, d, "lineitem").filter_arrow(lambda b: pc.and_(pc.greater(b["l_quantity"], 30.0), pc.equal(b["l_returnflag"], "R"))).df


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal * 2 AS s_acctbal, s_nationkey + 1 AS next FROM supplier")
def with_column_arrow(spark, d):
    doubled = at(spark, d, "supplier").with_column_arrow("s_acctbal", lambda b: pc.multiply(b["s_acctbal"], 2.0))
    return doubled.with_column_arrow("next", lambda b: pc.add(b["s_nationkey"], pa.scalar(1, pa.int32())), "int").df


@query("SELECT o_orderkey, o_totalprice FROM orders")
def map_async(spark, d):
    async def same(batch: pa.RecordBatch) -> pa.RecordBatch:
        await asyncio.sleep(0)
        return batch

    return at(spark, d, "orders").select("o_orderkey", "o_totalprice").map_async(same, max_in_flight=4).df


class CountAndSum(OneInputOperator):
    """Per key, rows and a total, kept in state and emitted when the input has ended."""

    def open(self, ctx):
        self.ctx = ctx

    def process(self, batch, out):
        rows = pa.table({"k": batch.column(0), "v": batch.column(1).cast(pa.int64())}).group_by("k").aggregate([("v", "count"), ("v", "sum")])
        pairs = zip(*(rows.column(c).to_pylist() for c in ("k", "v_count", "v_sum")))
        self.ctx.reduce_all("totals", ((k, (n, v)) for k, n, v in pairs), lambda a, b: (a[0] + b[0], a[1] + b[1]))
        self.ctx.metrics.incr("rows", batch.num_rows)

    def on_eos(self, out):
        rows = [(k.key, n, total) for k, (n, total) in self.ctx.entries("totals")]
        columns = list(zip(*rows)) or [(), (), ()]
        types = (pa.int64(), pa.int64(), pa.int64())
        out.emit(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["l_suppkey", "n", "total"]))


@query("SELECT l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def apply_on_eos(spark, d):
    rows = at(spark, d, "lineitem").select("l_suppkey", "l_linenumber")
    return rows.apply(CountAndSum, "l_suppkey long, n long, total long", key_columns=["l_suppkey"]).df


class CountAsync(AsyncOneInputOperator):
    """A keyed count whose batches take an awaited detour."""

    async def fetch(self, batch):
        await asyncio.sleep(0)
        return batch.column(0).value_counts().to_pylist()

    def integrate(self, batch, result, ctx, out):
        for item in result:
            ctx.reducing_state("n", KeyContext(item["values"]), lambda a, b: a + b).add(item["counts"])

    def on_eos(self, ctx, out):
        rows = [(k.key, n) for k, n in ctx.entries("n")]
        columns = list(zip(*rows)) or [(), ()]
        out.emit(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["o_custkey", "n"]))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def apply_async_keyed(spark, d):
    return at(spark, d, "orders").select("o_custkey").apply_async(CountAsync, "o_custkey long, n long", key_columns=["o_custkey"]).df


class FirstOfBoth(TwoInputOperator):
    """Per key, how many rows each side has."""

    def open(self, ctx):
        self.key, self.n = None, [0, 0]

    def process_left(self, batch, out):
        self.key, self.n[0] = batch.column(0)[0].as_py() if batch.num_rows else self.key, self.n[0] + batch.num_rows

    def process_right(self, batch, out):
        self.key, self.n[1] = batch.column(0)[0].as_py() if batch.num_rows else self.key, self.n[1] + batch.num_rows

    def on_eos(self, out):
        columns = [pa.array([self.key], pa.int32()), pa.array([self.n[0]], pa.int64()), pa.array([self.n[1]], pa.int64())]
        out.emit(pa.RecordBatch.from_arrays(columns, ["nation", "customers", "suppliers"]))


@query(
    "SELECT CAST(coalesce(a.k, b.k) AS INTEGER) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM"
    " (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k"
)
def apply_two_inputs(spark, d):
    left, right = at(spark, d, "customer").select("c_nationkey"), at(spark, d, "supplier").select("s_nationkey")
    schema = "nation int, customers long, suppliers long"
    return left.apply_two(right, FirstOfBoth, schema, left_keys=["c_nationkey"], right_keys=["s_nationkey"]).df


# sources and sinks


class Squares(SourceOperator):
    """Authored source in two splits."""

    schema = "i long, square long"

    def partitions(self):
        return [(0, 500), (500, 1000)]

    async def batches(self, partition):
        for i in range(*partition, 100):
            await asyncio.sleep(0)
            some = range(i, i + 100)
            yield pa.RecordBatch.from_pydict({"i": list(some), "square": [j * j for j in some]})


@query("SELECT i, i * i AS square FROM range(1000) t(i)")
def authored_source(spark, d):
    return connector.read(spark, Squares)


@query("SELECT i AS slice, unnest(range(i * 10, i * 10 + 10)) AS v FROM range(20) t(i)")
def sliced_source(spark, d):
    make = lambda i: pa.table({"slice": [i] * 10, "v": list(range(i * 10, i * 10 + 10))})
    return connector.sliced(spark, 20, make, "slice long, v long", 4)


@query("SELECT i AS chunk, i * 3 AS v FROM range(12) t(i)")
def chunk_source(spark, d):
    async def read(i):
        await asyncio.sleep(0)
        return pa.table({"chunk": [i], "v": [i * 3]})

    return connector.chunks(spark, list(range(12)), read, "chunk long, v long", 4)


@query("SELECT p_partkey, p_size FROM part")
def sink_roundtrip(spark, d):
    path = f"{_uri(live.checkpoint_path(spark))}/sink-{uuid.uuid4().hex}"
    at(spark, d, "part").select("p_partkey", "p_size").sink(lambda: ParquetSink(path)).run()
    return spark.read.parquet(path)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def partitioned_write(spark, d):
    path = f"{live.checkpoint_path(spark)}/orders-{uuid.uuid4().hex}"
    at(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write(path, partition_by=["o_orderstatus"])
    return source(path, spark).select("o_orderkey", "o_totalprice", "o_orderstatus").df


@query("SELECT i % 50 AS key, count(*) AS count FROM range(10000) t(i) GROUP BY 1")
def synthetic_keyed(spark, d):
    return source(synthetic.keyed(spark, 10_000, 50)).count_by("key").df


@query("SELECT 'w' || (i % 100) AS word, count(*) AS count FROM range(4000) t(i) GROUP BY 1")
def synthetic_text(spark, d):
    return source(synthetic.text(spark, 500, 8, 100)).tokenize("line").count_by("word").df


@query("SELECT i % 40 AS key, CAST(1 AS BIGINT) AS lval, i % 40 AS rval FROM range(2000) t(i)")
def synthetic_join(spark, d):
    return source(synthetic.join_stream(spark, 2000, 40)).join(source(synthetic.join_table(spark, 40)), on="key").df


@query("SELECT (i % 60) * 24 + (i // 60) % 24 AS gid, count(*) AS count FROM range(2880) t(i) GROUP BY 1")
def synthetic_grid(spark, d):
    return source(synthetic.grid(spark, 2, 6, 10)).count_by("gid").df


def _draw(seed: int) -> str:
    """The generated inputs' hash of i, in SQL."""
    a, b, c = synthetic.MIX
    x = f"((i * {a} + {seed * c % (1 << 32)}) % 4294967296)"
    y = f"((xor({x}, {x} >> 15) * {b}) % 4294967296)"
    return f"(xor({y}, {y} >> 13) / CAST(4294967296 AS DOUBLE))"


_ZIPF = ", ".join(f"({i}, '{s!r}'::DOUBLE, {o})" for i, (s, o) in enumerate(zip(*synthetic.zipf_table(100, 1.5))))


@query(
    f"WITH drawn AS (SELECT {_draw(7)} * 100 AS x FROM range(50000) t(i)), zipf(slot, share, other) AS (VALUES {_ZIPF})"
    " SELECT CASE WHEN x - floor(x) < share THEN slot ELSE other END::BIGINT AS key, count(*) AS count FROM drawn JOIN zipf ON floor(x) = slot GROUP BY 1"
)
def skew_count(spark, d):
    """The published skewed load: zipf keys of exponent 1.5."""
    return pipelines.bench_skew(spark, 50_000, 100).df


@query(
    f"SELECT CASE WHEN {_draw(8)} >= 0.25 THEN i % 10 END AS key, CAST(floor({_draw(9)} * 50) + 1 AS BIGINT) AS value, i AS ts, 'xxxx' AS payload,"
    " CAST(1 AS BIGINT) AS v0, CAST(1 AS BIGINT) AS v1 FROM range(2000) t(i)"
)
def synthetic_knobs(spark, d):
    return synthetic.keyed(spark, 2000, 10, null_fraction=0.25, payload_bytes=4, extra_values=2, value_spread=50)


@query("SELECT chr(CAST(97 + (n + i) % 3 AS INTEGER)) AS key, (n * 3 + i) % 17 + 1 AS val FROM range(20) a(n), range(3) b(i)")
def demo_stream(spark, d):
    return synthetic.demo_stream(spark, interval=0.01)


@query("SELECT chr(CAST(97 + (n + i) % 3 AS INTEGER)) AS key, count(*) AS count FROM range(8) a(n), range(3) b(i) GROUP BY 1")
def live_authored_source(spark, d):
    ticks = Stream(connector.read_live(spark, lambda: synthetic.Ticks(0, 8)))
    return live.available_now(ticks.count_by("key").df)


_CUBE = np.arange(4 * 6 * 5, dtype=np.float64).reshape(4, 6, 5)


@query("SELECT t.i AS t, x.i AS x, sum(CAST(t.i * 30 + y.i * 5 + x.i AS DOUBLE)) AS total FROM range(4) t(i), range(6) y(i), range(5) x(i) GROUP BY 1, 2")
def zarr_slices(spark, d):
    """A chunked array written and read selection by selection."""
    path = f"{_uri(live.checkpoint_path(spark))}/cube"
    zarr.write(f"{path}/v", _CUBE, (2, 4, 3))

    def columns(selection, arrays):
        rows = arrays["v"]
        return {"t": np.full(rows.size, selection[0]), "x": np.tile(np.arange(rows.shape[1]), len(rows)), "v": rows.reshape(-1)}

    rows = zarr.slices(spark, path, ["v"], [(t, half) for t in range(4) for half in (slice(0, 3), slice(3, 6))], columns, "t long, x long, v double", 2)
    return source(rows).agg_by(("t", "x"), total=("v", "sum")).df


@query(
    "SELECT m.i * 2 + l.i AS mlkey, (s.i + l.i) * 30 + c.i AS gid, CAST(s.i * 60 + l.i * 30 + c.i + m.i * 1000 AS FLOAT) AS temp_f"
    " FROM range(2) m(i), range(2) s(i), range(2) l(i), range(30) c(i) WHERE s.i + l.i < 2"
)
def zarr_forecasts(spark, d):
    """Two models' stores as one left input; slices whose time isn't known are left out."""
    path = f"{_uri(live.checkpoint_path(spark))}/models"
    for model in range(2):
        data = np.arange(2 * 2 * 6 * 5, dtype=np.float32).reshape(2, 2, 6, 5) + 1000 * model
        zarr.write(f"{path}/{model}/2m_temperature", data, (1, 1, 4, 5), "zstd")
    valid = lambda start, lead, cells: cells + (start + lead) * 30 if start + lead < 2 else None
    return zarr.forecasts(spark, [(m, f"{path}/{m}", [0, 1]) for m in range(2)], 2, np.arange(30), valid)


@query("SELECT 'scene ' || i AS item_id, CAST(i AS DOUBLE) / 10 AS mean_ndvi FROM range(7) t(i)")
def upsert_sink(spark, d):
    """A row per key, the same after it is written twice."""
    path = f"{_uri(live.checkpoint_path(spark))}/upserts"
    rows = spark.range(7).select(F.concat(F.lit("scene "), "id").alias("item_id"), (F.col("id") / 10).alias("mean_ndvi"))
    for _ in range(2):
        source(rows).sink(lambda: UpsertSink(path)).run()
    return spark.read.schema("item_id string, mean_ndvi double").json(path)


# streaming


def _live(spark: SparkSession, d: str, name: str) -> Stream:
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return Stream(live.read_stream(spark, f"{d}/{name}.parque[t]", schema))


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def streaming_count(spark, d):
    return live.available_now(_live(spark, d, "events").count_by("event_type").df)


@query("SELECT user_id, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def streaming_agg(spark, d):
    out = _live(spark, d, "events").agg_by("user_id", n=("value", "count"), total=("value", "sum"))
    return live.available_now(out.df).withColumn("total", F.round("total", 4))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def streaming_join_inner(spark, d):
    orders = _live(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = _live(spark, d, "customer").select("c_custkey", "c_name")
    return live.available_now(orders.join(customers, left_on="o_custkey", right_on="c_custkey").df)


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN (SELECT c_custkey + 37 AS c_custkey, c_name FROM customer) ON o_custkey = c_custkey")
def streaming_join_static(spark, d):
    orders = _live(spark, d, "orders").select("o_orderkey", "o_custkey")
    _, customers = _sides(spark, d)
    return live.available_now(orders.join(customers, left_on="o_custkey", right_on="c_custkey", how="left").df)


@query("SELECT o_orderkey, o_custkey, n AS \"Aggregate\" FROM orders JOIN (SELECT c_custkey, count(*) AS n FROM customer GROUP BY 1) ON o_custkey = c_custkey")
def streaming_join_static_agg(spark, d):
    """Live rows against a static aggregate: the rows append, whatever stands still beside them."""
    orders = _live(spark, d, "orders").select("o_orderkey", "o_custkey")
    counted = at(spark, d, "customer").count_by("c_custkey", "Aggregate")
    return live.available_now(orders.join(counted, left_on="o_custkey", right_on="c_custkey").df)


@query("SELECT o_orderstatus, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def stateful_reduce(spark, d):
    rows = _live(spark, d, "orders").select("o_orderstatus", "o_orderkey").df
    return live.last_per_key(spark, live.reduce_by_key(rows, "o_orderstatus", "o_orderkey", max), "o_orderstatus")
