"""SimHash near-dedup: tiled exact comparison of fingerprints.

Distinct fingerprints are dealt to tiles by their number of set bits, large
numbers of equal population count to several tiles of bounded size.  Tile pairs
whose counts differ by more than the radius are never formed.  Within a pair the
same rule is applied again and again to the eight bytes of a fingerprint (the
differences of their counts add up to at most the distance), and what is left is
compared by exclusive-or and bit counts in numpy.  A pair of tiles returns a
spanning forest of its links, so a group of n near copies gives at most n rows,
and the forests are joined by distributed connected components.

With `words` of 64 bits the tiles go by the first word, `radius` bounds its
distance and `wide_radius` that of all words together.

The pipeline's stage takes such links as candidates only.  The shingle sets of the
texts that have one are dealt to blocks of bounded size by component of candidates,
and a candidate becomes a link where the exact Jaccard similarity of the two sets is
STAGE_SIMILARITY or more; candidates that confirmed links already join are not tried.
Its fingerprints are those of the sets, and texts of one set are one node.

Defined cases
* null, empty or blank text: no words, fingerprint zero, linked like any other;
* fewer words than a shingle: the whole sequence is the one shingle;
* repeated rows, equal texts and ties count alike; a null doc_id gets its component
  but never names it (the name is null where no row of a component has an id);
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillworks.llm.common import materialize, small_batches
from rillworks.llm.graph import Forest, components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints of a tile: 8 bytes each and word, so a task holds a few MB.
TILE = 16384
#: Comparisons made at once.
BLOCK = 1 << 18

#: The pipeline's stage: five words; similarity 0.8 is a Jaccard similarity of shingles, whose
#: expected share of differing bits is acos(2 * 0.8 / 1.8) / pi = 0.151, or 10 of 64 and 39 of 256
#: bits.  The radii of candidates are some three standard deviations wider.
STAGE_SHINGLE = 5
STAGE_SIMILARITY = 0.8
STAGE_WORDS = 4
STAGE_RADIUS = 18
STAGE_WIDE_RADIUS = 56
#: Shingles of a block of sets, 8 bytes each; a set counts as LEAST at least, which bounds the sets of a block.
SETS = 1 << 21
LEAST = 128

_MIX = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _more_bits(h: np.ndarray, word: int) -> np.ndarray:
    """Word 0: the hashes; others: independent bits by a multiply-xor-shift mix."""
    if word == 0:
        return h
    h = h ^ _MIX[word]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """A hash of each run of `shingle` words."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(tokens) - shingle + 1)
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()][:n]
    stops = ends[shingle - 1 :].tolist() if len(tokens) >= shingle else [len(line)]
    return np.fromiter((xxh64_intdigest(line[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, n)


def simhash(text: str | None, shingle: int = SHINGLE, words: int = 1) -> np.ndarray:
    """`words` unsigned 64-bit words; a bit is 1 if set in over half of the shingles' hashes."""
    return _majority(shingles(text, shingle), words)


def _majority(hashes: np.ndarray, words: int) -> np.ndarray:
    out, n = np.zeros(words, dtype=np.uint64), len(hashes)
    if not n:
        return out
    for word in range(words):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 65536):
            bits = _more_bits(hashes[at : at + 65536], word).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[word] = np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """(doc_id, fp): fp is an array of `words` longs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(text, shingle, words).view(np.int64).tolist() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp array<long>")


def _set_of(text: str | None) -> tuple[np.ndarray, int]:
    """A text's distinct shingles, sorted, and their digest."""
    from xxhash import xxh64_intdigest

    own = np.unique(shingles(text, STAGE_SHINGLE))
    return own, int(np.uint64(xxh64_intdigest(own.astype("<u8").tobytes(), SEED)).view(np.int64))


def _text_hash() -> Column:
    return F.xxhash64("text")


def _set_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, node, fp, n): a hash of the text; digest, fingerprint and size of its set of shingles."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_set_of(text) for text in batch.column(2).to_pylist()]
            fps = [_majority(own, STAGE_WORDS).view(np.int64).tolist() for own, _ in sets]
            arrays = [pa.array([x for _, x in sets], pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array([len(x) for x, _ in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "h", "node", "fp", "n"])

    return docs.select("doc_id", _text_hash().alias("h"), "text").mapInArrow(run, "doc_id long, h long, node long, fp array<long>, n long")


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, wide_radius: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of positions (i in a, j in b) of all pairs within the radius."""
    counts_a = np.bitwise_count(np.ascontiguousarray(a[:, 0]).view(np.uint8).reshape(-1, 8))
    counts_b = np.bitwise_count(np.ascontiguousarray(b[:, 0]).view(np.uint8).reshape(-1, 8))

    def leaf(ia: np.ndarray, ib: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step, first_b = max(1, BLOCK // len(ib)), b[ib, 0]
        for at in range(0, len(ia), step):
            some = ia[at : at + step]
            i, j = np.nonzero(np.bitwise_count(a[some, 0][:, None] ^ first_b[None, :]) <= radius)
            i, j = some[i], ib[j]
            if wide_radius is not None and len(i):
                near = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int64) <= wide_radius
                i, j = i[near], j[near]
            if len(i):
                yield i, j

    def walk(ia: np.ndarray, ib: np.ndarray, left: int, byte: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(ia) or not len(ib):
            return
        if byte == 8 or len(ia) * len(ib) <= BLOCK:
            yield from leaf(ia, ib)
            return
        parts_a = [ia[counts_a[ia, byte] == k] for k in range(9)]
        parts_b = [ib[counts_b[ib, byte] == k] for k in range(9)]
        for k, part in enumerate(parts_a):
            for m in range(max(0, k - left), min(8, k + left) + 1):
                yield from walk(part, parts_b[m], left - abs(k - m), byte + 1)

    yield from walk(np.arange(len(a)), np.arange(len(b)), radius, 0)


def _compare(a: np.ndarray, b: np.ndarray | None, radius: int, wide_radius: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) positions of a spanning forest of the links in a tile (b None) or between two."""
    nodes = a if b is None else np.concatenate([a, b])
    forest, shift = Forest(len(nodes)), 0 if b is None else len(a)
    for i, j in near_pairs(a, a if b is None else b, radius, wide_radius):
        if b is None:
            i, j = i[i < j], j[i < j]
        forest.link(i, j + shift)
    roots = forest.roots(np.arange(len(nodes)))
    node = np.flatnonzero(roots != np.arange(len(nodes)))
    return node, roots[node]


def near_links(fps: DataFrame, radius: int = RADIUS, wide_radius: int | None = None, tile: int = TILE) -> DataFrame:
    """(u, v): a spanning forest, per pair of tiles, of the links among `fps` (node, fp) of distinct nodes."""
    first = F.col("fp")[0]
    rows = fps.select(F.bit_count(first).alias("p"), F.xxhash64("node").alias("h"), "node", "fp")
    counts = {row.p: row.n for row in rows.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # 65 rows at most
    subs = F.array(*[F.lit(-(-counts.get(p, 0) // tile)) for p in range(65)])
    of = lambda p: F.element_at(subs, p + 1)
    tiles = materialize(
        rows.groupBy("p", F.pmod("h", of(F.col("p"))).cast("int").alias("s"))
        .agg(F.collect_list(F.struct("node", "fp")).alias("rows"))
        .select("p", "s", F.col("rows.node").alias("nodes"), F.flatten("rows.fp").alias("fps")),
        "tiles",
    )

    def partners(p, s):
        near = F.sequence(p, F.least(p + radius, F.lit(64)))
        some = lambda q: F.transform(
            F.filter(F.sequence(F.lit(0), of(q)), lambda t: (t < of(q)) & ((q > p) | (t >= s))), lambda t: F.struct(q.alias("q"), t.alias("t"))
        )
        return F.flatten(F.transform(near, some))

    left = tiles.select("p", "s", "nodes", "fps", F.explode(partners(F.col("p"), F.col("s"))).alias("x"))
    left = left.select(
        F.col("x.q").alias("p2"), F.col("x.t").alias("s2"), "nodes", "fps", ((F.col("p") == F.col("x.q")) & (F.col("s") == F.col("x.t"))).alias("own")
    )
    right = tiles.select(F.col("p").alias("p2"), F.col("s").alias("s2"), F.col("nodes").alias("nodes2"), F.col("fps").alias("fps2"))
    pairs = left.join(right, ["p2", "s2"]).select("own", "nodes", "fps", "nodes2", "fps2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(column: pa.Array, at: int) -> np.ndarray:
            return column[at].values.to_numpy(zero_copy_only=False).copy()

        for batch in batches:
            for at in range(batch.num_rows):
                nodes, a = arrays(batch.column(1), at), arrays(batch.column(2), at).view(np.uint64)
                a, b = a.reshape(len(nodes), -1), None
                if not batch.column(0)[at].as_py():
                    more = arrays(batch.column(3), at)
                    b = arrays(batch.column(4), at).view(np.uint64).reshape(len(more), -1)
                    nodes = np.concatenate([nodes, more])
                u, v = _compare(a, b, radius, wide_radius)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def near_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, words: int = 1, wide_radius: int | None = None, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id, root) for every row: the smallest doc_id reachable over links; root tells components apart."""
    rows = materialize(fingerprints(docs, shingle, words), "fingerprints")
    node = F.col("fp")[0] if words == 1 else F.xxhash64("fp")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", node), "distinct")
    found = components(near_links(distinct, radius, wide_radius, tile), "u", "v")
    rooted = distinct.join(found, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    # written, so that AQE can split the join of a component that holds very many fingerprints
    names = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = rooted.join(names, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def confirmed(a: list[np.ndarray], fps_a: np.ndarray, b: list[np.ndarray] | None = None, fps_b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) positions of a spanning forest of the confirmed links among sets (b None) or between two lists of them."""
    sets, shift = a if b is None else [*a, *b], 0 if b is None else len(a)
    sizes, forest = np.array([len(x) for x in sets]), Forest(len(sets))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    ids, mark = [codes[e - n : e] for e, n in zip(ends, sizes)], np.zeros(len(codes), dtype=bool)
    for i, j in near_pairs(fps_a, fps_a if b is None else fps_b, STAGE_RADIUS, STAGE_WIDE_RADIUS):
        j = j + shift
        if b is None:
            i, j = i[i < j], j[i < j]
        fit = np.minimum(sizes[i], sizes[j]) >= STAGE_SIMILARITY * np.maximum(sizes[i], sizes[j])
        i, j = i[fit], j[fit]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for own, mates in zip(i[np.flatnonzero(np.diff(i, prepend=-1))], np.split(j, np.flatnonzero(np.diff(i)) + 1)):
            mates = mates[forest.roots(mates) != forest.roots(np.array([own]))]
            if not len(mates):
                continue
            mark[ids[own]] = True
            both = np.array([np.count_nonzero(mark[ids[m]]) for m in mates.tolist()])
            mark[ids[own]] = False
            # the tolerance is for 0.8 times a whole number, not for near misses: those are off by 0.2 or more
            mates = mates[both >= STAGE_SIMILARITY * (sizes[own] + sizes[mates] - both) - 1e-6]
            forest.link(np.full(len(mates), own), mates)
    roots = forest.roots(np.arange(len(sets)))
    node = np.flatnonzero(roots != np.arange(len(sets)))
    return node, roots[node]


def confirmed_links(docs: DataFrame, distinct: DataFrame, limit: int = SETS) -> DataFrame:
    """(u, v): a spanning forest, per pair of blocks, of the candidates that the exact similarity confirms.

    `distinct` (node, fp, n, first) has a node per set of shingles, with the id and the
    hash of a text that has it.
    """
    found = components(near_links(distinct.select("node", "fp"), STAGE_RADIUS, STAGE_WIDE_RADIUS), "u", "v")
    found = materialize(found.union(found.select(F.col("root").alias("node"), "root").distinct()), "candidates")
    wanted = materialize(distinct.join(found, "node").select("root", "node", "n", "first"), "wanted")
    # components beyond a block's size: at most as many as all shingles over `limit`
    total = wanted.groupBy("root").agg(F.sum(F.greatest("n", F.lit(LEAST))).alias("total")).where(F.col("total") > limit)
    large = total.select("root", F.ceil(F.col("total") / limit).cast("int").alias("subs"))
    wanted = wanted.join(F.broadcast(large), "root", "left").withColumn("subs", F.coalesce("subs", F.lit(1)))
    wanted = wanted.select(
        "root", F.pmod(F.xxhash64("node"), "subs").cast("int").alias("s"), "subs", F.coalesce("first.doc_id", F.lit(0)).alias("k"), F.col("first.h").alias("h")
    )
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("k"), _text_hash().alias("h"), "text")
    texts = texts.join(wanted.hint("shuffle_hash"), ["k", "h"]).dropDuplicates(["k", "h"]).select("root", "s", "subs", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_set_of(text) for text in batch.column(3).to_pylist()]
            fps = [_majority(x, STAGE_WORDS).view(np.int64).tolist() for x, _ in own]
            arrays = [pa.array([x for _, x in own], pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array([x.astype("<u8").tobytes() for x, _ in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], ["root", "s", "subs", "node", "fp", "own"])

    made = texts.mapInArrow(sets, "root long, s int, subs int, node long, fp array<long>, own binary")
    blocks = materialize(made.groupBy("root", "s", "subs").agg(F.collect_list(F.struct("node", "fp", "own")).alias("rows")), "sets")
    left = blocks.where("subs > 1").select("root", F.explode(F.expr("filter(sequence(0, subs - 1), t -> t > s)")).alias("s"), "rows")
    pairs = left.join(blocks.select("root", "s", F.col("rows").alias("more")), ["root", "s"]).select("rows", "more")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(column: pa.Array, at: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            rows = column[at].values
            nodes = rows.field("node").to_numpy(zero_copy_only=False)
            fps = np.array(rows.field("fp").to_pylist(), dtype=np.int64).view(np.uint64).reshape(len(nodes), -1)
            return nodes, fps, [np.frombuffer(x.as_buffer(), "<u8") for x in rows.field("own")]

        for batch in batches:
            for at in range(batch.num_rows):
                nodes, fps, own = parts(batch.column(0), at)
                if batch.num_columns == 1:
                    u, v = confirmed(own, fps)
                else:
                    more, more_fps, more_own = parts(batch.column(1), at)
                    nodes = np.concatenate([nodes, more])
                    u, v = confirmed(own, fps, more_own, more_fps)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], ["u", "v"])

    return blocks.select("rows").mapInArrow(compare, "u long, v long").union(pairs.mapInArrow(compare, "u long, v long"))


def similar_components(docs: DataFrame, limit: int = SETS) -> DataFrame:
    """(doc_id, h, node, component_id, root) for every row, over confirmed links: h is a hash of the text."""
    rows = materialize(_set_fingerprints(docs), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    distinct = materialize(rows.groupBy("node", "fp", "n").agg(first), "distinct")
    found = components(confirmed_links(docs, distinct, limit), "u", "v")
    rooted = distinct.join(found, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    names = materialize(rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id")), "names")
    named = rooted.join(names, "root").select("node", "component_id", "root")
    return rows.join(named, "node").select("doc_id", "h", "node", "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the row with the smallest doc_id.

    Of rows that share that doc_id the one with the least hash of its text stays, and of
    equal texts one.  A row with a null doc_id stays only where no row of its component has an id.
    """
    none, k = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))
    first = F.min(F.struct(none.alias("none"), "doc_id", "h")).alias("first")
    # a component per row: rows that share a doc_id may be in several
    keep = similar_components(docs).groupBy("root").agg(first)
    keep = materialize(keep.select(F.col("first.none").alias("__none"), F.coalesce("first.doc_id", F.lit(0)).alias("__k"), F.col("first.h").alias("__h")), "kept")
    # one exchange of the texts serves the join and the removal of repeated rows
    by = ["__none", "__k", "__h"]
    keyed = docs.withColumns({"__none": none, "__k": k, "__h": _text_hash()})
    return keyed.join(keep.hint("shuffle_hash"), by, "left_semi").dropDuplicates(by).select(*[F.col(f"`{c}`") for c in docs.columns])
