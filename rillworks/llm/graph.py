"""Connected components by alternating large-star and small-star rounds.

All state is in tables: each round is written to the shared folder, nothing is
gathered on the driver but a count and a checksum that tell whether a round
changed anything.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillworks.llm.common import materialize_at, plain_unions, remove_path


def _edges(df: DataFrame, a, b) -> DataFrame:
    return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")


def _least(edges: DataFrame) -> tuple[DataFrame, str]:
    """(k, m): the least neighbour of each u.  Written, so that the join with it reads plain exchanges
    on both sides, of which AQE can split that of a node with very many neighbours."""
    return materialize_at(edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "least")


def _round(edges: DataFrame) -> tuple[DataFrame, str]:
    """A large-star then a small-star step over (u, v), u > v; the table written and its path."""
    spark = edges.sparkSession
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, path = _least(both)
    own = both.join(least.hint("merge"), F.col("u") == F.col("k")).where("v > u")
    large, large_path = materialize_at(_edges(own, F.col("v"), F.least("k", "m")).distinct(), "large-stars")
    remove_path(spark, path)
    least, path = _least(large)
    moved = _edges(large.join(least.hint("merge"), F.col("u") == F.col("k")), F.col("v"), F.col("m"))
    stars = materialize_at(moved.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "stars")
    remove_path(spark, path)
    remove_path(spark, large_path)
    return stars


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge that isn't the least of its component; root is the least."""
    spark = edges.sparkSession
    plain_unions(spark)
    edges, path = materialize_at(_edges(edges, F.col(a), F.col(b)).distinct(), "edges")
    stamp = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    last = stamp(edges)
    while last[0]:
        edges, new_path = _round(edges)
        remove_path(spark, path)
        now, path = stamp(edges), new_path
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


class Forest:
    """Union-find over positions 0..n-1 that takes whole arrays of links; the root is the least position."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        parent = self.parent
        up = parent[at]
        while True:
            top = parent[up]
            if (top == up).all():
                return up
            parent[at], up = top, top

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                return
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            np.minimum.at(self.parent, high, low)
