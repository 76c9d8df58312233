"""Approximate nearest neighbours by collision counting over single projections.

The index deals vectors to blocks of bounded size, and of norms within a factor of
`BAND`.  A block holds, per projection, its vectors in sorted order.  A query opens a
window centred on its own projection in every sorted array, and a vector collides
where its place lies in the window; virtual rehashing widens all windows by one
factor until enough distinct vectors have reached the collision threshold (measured on
every so many vectors of the block, `SAMPLE` of them or more), and all of the block's that
have are verified by exact inner products.  The projections are the axes of
random rotations, which together lose nothing of a distance but what windows lose.
Largest inner products become nearest neighbours by one added coordinate,
sqrt(largest norm of the block^2 - norm^2), and queries scaled to that norm.  Equal
vectors are indexed once per block, with all their ids, so many copies neither crowd
out candidates nor get lost.

A block is built once, in the task that all its query chunks are dealt to (in a few
tasks where there are fewer blocks than cores).  Every query visits every block and
counts collisions with each of its vectors, so the work grows with queries * vectors.

Defined cases
* a vector that is null, empty, zero, or holds null or non-finite components takes no part,
  nor does one without an id, or of another length than the table's most common (the smallest of these);
* fewer candidates than k: all of them; a query is never its own neighbour;
* rows that repeat an id ask and answer with each of their vectors and keep the best score per pair of ids;
  rows equal in id and vector count once, and rows of one id are dealt to all blocks;
* a block of no more distinct vectors than a query verifies is verified whole;
* ties go to the smaller vec_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillworks.llm.common import materialize, small_batches

K = 20
EVERY = 20
#: Projections: whole rotations, together at least as many.
PROJECTIONS = 96
#: Collisions a candidate needs, as a share of the projections.
COLLISIONS = 0.8
#: Distinct vectors of a block that must reach it: a share and a number, beyond k.
VERIFY, MORE = 0.02, 65
#: First half-width in standard deviations of a projection, and the factor of virtual rehashing.
WIDTH, GROWTH = 0.1, 1.03
#: Vectors of a block, the factor its norms lie within, queries of a chunk, and vectors counted at once.
BLOCK = 16384
BAND = 1.25
CHUNK = 512
SLICE = 8192
#: Vectors of a block on which a widening is judged.
SAMPLE = 2048


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(v.isNotNull() & F.col("vec_id").isNotNull() & sound & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    rows = rows.where(F.size(v) == (sizes[0]["size"] if sizes else 0))
    return rows.select("vec_id", v.cast("array<double>").alias("v")).dropDuplicates(["vec_id", "v"])


def projections(dims: int, count: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    """A row per projection, in rotations of dims + 1 rows each; the last coordinate is the added one."""
    rng, size = np.random.default_rng(seed), dims + 1
    return np.concatenate([np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(-(-count // size))])


class Block:
    """The sorted arrays of one block and their search."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, count: int = PROJECTIONS):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.vectors, owner = np.unique(vectors, axis=0, return_inverse=True)
        owner = owner.reshape(-1)
        by = np.argsort(owner, kind="stable")  # ids of a vector, ascending
        self.ids, self.first = ids[by], np.searchsorted(owner[by], np.arange(len(self.vectors) + 1))
        norms = (self.vectors**2).sum(axis=1)
        self.top = float(np.sqrt(norms.max()))
        self.axes = projections(vectors.shape[1], count)
        m, n = len(self.axes), len(self.vectors)
        values = self.axes[:, :-1] @ self.vectors.T + self.axes[:, -1:] * np.sqrt(np.maximum(0, norms.max() - norms))
        self.scale = float(values.std()) or 1.0
        values /= self.scale
        # places are kept as cells of the sorted arrays, 256 at most; of each cell its least value, the
        # arrays' end to end and each moved beyond the one before it, so that one search places windows in all
        self.step, self.cells = 4 * (float(np.abs(values).max()) + 1), min(256, n)
        places = np.empty((m, n), dtype=np.uint8)
        cell = np.arange(n) * self.cells // n
        starts = np.searchsorted(cell, np.arange(self.cells))
        self.edges = np.empty((m, self.cells))
        for j in range(m):
            at = np.argsort(values[j], kind="stable")
            self.edges[j] = values[j, at[starts]] + j * self.step
            places[j, at] = cell
        self.edges = self.edges.reshape(-1)
        self.places = [np.ascontiguousarray(places[:, i : i + SLICE]) for i in range(0, n, SLICE)]
        self.every = max(1, n // SAMPLE)
        self.sample = [np.ascontiguousarray(places[:, :: self.every])]
        self.level, self.verified = 0, 0

    def _windows(self, centre: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Per projection the first cell of the window and how many follow; whether they hold all."""
        order = np.arange(len(self.axes))
        width, shift, start = WIDTH * GROWTH**level, order * self.step, order * self.cells
        # beyond half a step lies another array
        low = np.searchsorted(self.edges, np.maximum(centre - width, -self.step / 2) + shift, "right") - 1 - start
        high = np.searchsorted(self.edges, np.minimum(centre + width, self.step / 2) + shift, "right") - 1 - start
        low, high = np.maximum(low, 0), np.maximum(high, 0)
        return low.astype(np.uint8), (high - low).astype(np.uint8), bool(low.max() == 0 and high.min() == self.cells - 1)

    def _reached(self, parts: list[np.ndarray], centre: np.ndarray, level: int, need: int) -> tuple[np.ndarray, bool]:
        """The vectors with enough collisions, and whether the windows hold all."""
        first, more, whole = self._windows(centre, level)
        out = []
        for at, places in enumerate(parts):
            # one comparison says "first <= place <= first + more": below first the difference wraps around
            inside = (places - first[:, None]) <= more[:, None]
            counts = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint16 if len(places) > 255 else np.uint8)
            out.append(np.flatnonzero(counts >= need) + at * SLICE)
        return np.concatenate(out), whole

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """The distinct vectors with enough collisions at the first widening where as many as wanted have them."""
        n, m = len(self.vectors), len(self.axes)
        want, need = int(np.ceil(VERIFY * n)) + MORE + k + 1, int(np.ceil(COLLISIONS * m))
        if want >= n:
            found = np.arange(n)
        else:
            centre = self.axes[:, :-1] @ (query * (self.top / np.linalg.norm(query))) / self.scale
            level = self._level(centre, need, -(-want // self.every))
            found, whole = self._reached(self.places, centre, level, need)
            while len(found) <= k and not whole:  # the sample promised more
                level += 1
                found, whole = self._reached(self.places, centre, level, need)
        self.verified += len(found)
        return found

    def _level(self, centre: np.ndarray, need: int, want: int) -> int:
        """The first widening at which `want` vectors of the sample have enough collisions.

        Wider windows never lose a vector, so the search may begin where the last query's ended.
        """
        found, whole = self._reached(self.sample, centre, self.level, need)
        if len(found) >= want:
            while self.level and len(self._reached(self.sample, centre, self.level - 1, need)[0]) >= want:
                self.level -= 1
        else:
            while len(found) < want and not whole:
                self.level += 1
                found, whole = self._reached(self.sample, centre, self.level, need)
        return self.level

    def best(self, query_id: int, found: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k nearest among the candidates, whose exact inner products are given."""
        if len(found) > k + 1:  # the query's own vector may be among them
            keep = scores >= np.partition(scores, -(k + 1))[-(k + 1)]
            found, scores = found[keep], scores[keep]
        spans = [self.ids[self.first[i] : self.first[i + 1]] for i in found]
        spans = [s[s != query_id][:k] for s in spans]
        ids = np.concatenate(spans) if spans else np.zeros(0, dtype=np.int64)
        values = np.repeat(scores, [len(s) for s in spans])
        first = np.lexsort((ids, -values))[:k]
        return ids[first], values[first]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, ids, scores) of the k nearest found of each query; equal queries are searched for once."""
        distinct, owner = np.unique(queries, axis=0, return_inverse=True)
        askers = np.argsort(owner.reshape(-1), kind="stable")
        ends = np.cumsum(np.bincount(owner.reshape(-1), minlength=len(distinct)))
        out = []
        for q, own in zip(distinct, np.split(askers, ends[:-1])):
            found = self.candidates(q, k)
            scores = self.vectors[found] @ q
            for query_id in query_ids[own].tolist():
                near, best = self.best(query_id, found, scores, k)
                out.append((np.full(len(near), query_id), near, best))
        return tuple(np.concatenate(column) for column in zip(*out))


def _packed(rows: DataFrame, *by: str) -> DataFrame:
    """(by, ids, vectors): the rows of each group, their vectors end to end."""
    packed = rows.groupBy(*by).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    return packed.select(*by, F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("vectors"))


def blocks_of(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, dict[int, int]]:
    """`rows` with band and sub, which name a block of about `block` rows; and how many blocks each band has."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    banded = rows.withColumn("band", F.round(F.log(norm) / float(np.log(BAND))).cast("int"))
    # a row per band: no more than there are powers of BAND among the doubles
    subs = {r.band: -(-r["count"] // block) for r in banded.groupBy("band").count().collect()}
    n = F.create_map(*[F.lit(x) for pair in subs.items() for x in pair])[F.col("band")] if subs else F.lit(1)
    return banded.withColumn("sub", F.pmod(F.xxhash64("vec_id", "v"), n).cast("int")), subs


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = materialize(usable(vectors), "ann-rows")
    dealt, subs = blocks_of(rows, block)
    n_blocks = max(1, sum(subs.values()))
    # the tasks of a block: one, but where there are fewer blocks than cores
    tasks = -(-spark.sparkContext.defaultParallelism // n_blocks)
    queries = rows.where(F.col("vec_id") % every == 0)
    chunks = max(tasks, -(-queries.count() // CHUNK))
    asked = _packed(queries.withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "vec_id", "v"), F.lit(chunks)).cast("int")), "chunk")
    names = F.array(*[F.struct(F.lit(band).alias("band"), F.lit(sub).alias("sub")) for band, n in subs.items() for sub in range(n)]) if subs else F.expr("cast(array() as array<struct<band:int,sub:int>>)")
    asked = asked.withColumn("block", F.explode(names)).select("block.band", "block.sub", F.pmod("chunk", F.lit(tasks)).alias("task"), "chunk", "ids", "vectors")
    index = _packed(dealt, "band", "sub").select("band", "sub", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(-1).alias("chunk"), "ids", "vectors")
    # a block comes before its chunks
    stream = index.union(asked).repartition(n_blocks * tasks, "band", "sub", "task").sortWithinPartitions("band", "sub", "task", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda column, at: column[at].values.to_numpy(zero_copy_only=False)
        own = None
        for batch in batches:
            for at in range(batch.num_rows):
                ids = flat(batch.column(1), at)
                found = flat(batch.column(2), at).reshape(len(ids), -1)
                if batch.column(0)[at].as_py() < 0:
                    own = Block(ids, found)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in own.search(ids, found, k)], ["query_id", "vec_id", "score"])

    found = stream.select("chunk", "ids", "vectors").mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
