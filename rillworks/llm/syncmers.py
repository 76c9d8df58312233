"""Document fingerprints of closed syncmers.

A k-mer of code points is a closed syncmer if the least of its inner s-mers lies
at its first or last place.  Whether it is one depends on the k-mer alone, so an
edit disturbs only the anchors that overlap it.  A fingerprint holds each anchor's
hash and position, all of them, whatever the text's length: of several anchors of
one hash the first is matched with the first of the other text, the second with the
second.  Likeness matches anchors of equal hash whose positions differ by at most
`slack`, or have moved as far, within `slack`, as the next matched anchor on either
side (so a passage matches wherever it stands), and is 2 * matched / all anchors.

A text too short for the guarantee of an anchor (2k - s code points) has all its
s-mers as anchors; the empty text has none.

Defined cases
* null text: the empty text; likeness of two empty fingerprints is 1, of an empty and another 0;
* equal texts have equal fingerprints and likeness 1;
* "next document" goes by descending doc_id, rows of one doc_id by their text's hash, null ids last,
  and after the last comes the first; a lone row is its own next document;
  (many rows of one doc_id are dealt to several tasks by that hash; rows equal in both are worked out once);
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from binascii import b2a_base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillworks.llm.common import small_batches

K = 10
S = 4
#: Code points that a matched anchor may have moved.
SLACK = 1000
#: The key of a null id, and the upper end of all ties.
LEAST, HIGH = -(1 << 63), (1 << 63) - 1
#: Code points hashed at once.
CHUNK = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
#: A fingerprint holds the upper 32 bits of a hash.
TAIL, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n code points."""
    size = len(codes) - n + 1
    h = codes[:size].copy()
    for i in range(1, n):
        h = h * _P + codes[i : i + size]
    return _mix(h)


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers of a run of code points."""
    inner = _grams(codes, S)
    window = K - S + 1
    size = len(inner) - window + 1
    least = inner[:size].copy()
    for i in range(1, window):
        np.minimum(least, inner[i : i + size], out=least)
    at = np.flatnonzero((inner[:size] == least) | (inner[window - 1 :] == least))
    h = inner[at].copy()
    for i in (*range(S, K - S, S), K - S):  # the k-mer's hash from s-mers that cover it
        h = h * _P + inner[at + i]
    return at, _mix(h)


class Fingerprint:
    """The positions (ascending) and hashes of a text's anchors."""

    def __init__(self, at: np.ndarray, hashes: np.ndarray, n_chars: int):
        self.at, self.hashes, self.n_chars = at, hashes, n_chars

    @cached_property
    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, positions) by hash and position; a key is the hash and how many anchors of it come before."""
        packed = np.sort((self.hashes << TAIL) | self.at.astype(np.uint64))
        hashes, at = packed >> TAIL, (packed & LOW).astype(np.int64)
        order = np.arange(len(hashes))
        first = np.ones(len(hashes), dtype=bool)
        first[1:] = hashes[1:] != hashes[:-1]
        rank = order - np.maximum.accumulate(np.where(first, order, 0))
        return (hashes << TAIL) | rank.astype(np.uint64), at


def syncmers(text: str) -> Fingerprint:
    """A text's fingerprint."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return Fingerprint(*_hashed(codes), len(codes))


def _hashed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) < 2 * K - S:
        n = min(S, len(codes))
        hashes = _grams(codes, n) if n else np.zeros(0, dtype=np.uint64)
        return np.arange(len(hashes)), hashes >> TAIL
    parts = [(start, *_anchors(codes[start : start + CHUNK + K - 1])) for start in range(0, len(codes) - K + 1, CHUNK)]
    at = np.concatenate([start + p for start, p, _ in parts])
    return at, np.concatenate([h for _, _, h in parts]) >> TAIL


def changed_after(own: Fingerprint, text: str, same: int) -> Fingerprint:
    """The fingerprint of `text`, whose first `same` code points are those of `own`'s text: only the rest is hashed."""
    if min(own.n_chars, len(text)) < 2 * K - S or same < K:
        return syncmers(text)
    kept = np.searchsorted(own.at, same - K, "right")  # anchors that lie wholly in the common start
    rest = text[same - K + 1 :]
    at, hashes = own.at[:kept], own.hashes[:kept]
    if len(rest) >= K:
        codes = np.frombuffer(rest.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        for start in range(0, len(codes) - K + 1, CHUNK):
            more, more_hashes = _anchors(codes[start : start + CHUNK + K - 1])
            at = np.concatenate([at, more + (start + same - K + 1)])
            hashes = np.concatenate([hashes, more_hashes >> TAIL])
    return Fingerprint(at, hashes, len(text))


def render(fingerprint: Fingerprint) -> str:
    """A text of all anchors: the bytes of a gap ("2:" or "4:"), then in base64 the gaps between positions and the hashes, little-endian."""
    gaps = np.diff(fingerprint.at, prepend=0)
    size = 2 if not len(gaps) or gaps.max() <= 0xFFFF else 4
    return f"{size}:" + b2a_base64(gaps.astype(f"<u{size}").tobytes() + fingerprint.hashes.astype("<u4").tobytes(), newline=False).decode()


def likeness(a: Fingerprint, b: Fingerprint, slack: int = SLACK) -> float:
    """Share of anchors that match in hash and, within `slack`, in position or in how far their neighbours moved."""
    if not len(a.at) and not len(b.at):
        return 1.0
    if not len(a.at) or not len(b.at):
        return 0.0
    (keys_a, at_a), (keys_b, at_b) = a.ranked, b.ranked
    place = np.minimum(np.searchsorted(keys_b, keys_a), len(keys_b) - 1)
    both = keys_b[place] == keys_a
    pairs = np.sort((at_a[both].astype(np.uint64) << TAIL) | at_b[place[both]].astype(np.uint64))  # positions in a ascend
    moved = (pairs & LOW).astype(np.int64) - (pairs >> TAIL).astype(np.int64)
    ok, along = np.abs(moved) <= slack, np.abs(np.diff(moved)) <= slack
    ok[1:] |= along
    ok[:-1] |= along
    return float(2 * ok.sum() / (len(a.at) + len(b.at)))


def edited(text: str, following: str) -> str:
    """The last third of `text` replaced by as many code points (or all) from the start of `following`."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _bounds(keyed: DataFrame, wanted: int) -> list[tuple[int, int]]:
    """(k, tie) of the upper ends of some `wanted` ranges, ascending; a k that fills several is cut at quantiles of its ties."""
    at = [i / wanted for i in range(1, wanted)]
    cuts = keyed.agg(F.percentile_approx("k", at, 100 * wanted).alias("c")).first().c or []
    times = {k: cuts.count(k) for k in cuts}
    bounds = {(k, HIGH) for k in times}
    hot = [k for k, n in times.items() if n > 1]  # fewer than `wanted`
    if hot:
        rows = keyed.where(F.col("k").isin(hot)).groupBy("k").agg(F.percentile_approx("tie", at, 100 * wanted).alias("c")).collect()
        bounds |= {(r.k, r.c[i * (wanted - 1) // (times[r.k] + 1)]) for r in rows for i in range(1, times[r.k] + 1)}
    return sorted(bounds)


def ordered_pairs(docs: DataFrame, parts_per_task: int = 4) -> DataFrame:
    """The rows dealt to ranges of descending (doc_id, hash of the text); each range ends with a copy of the row that follows it.

    Columns: part, sentinel (true: the copy), doc_id, text (pressed), sorted within parts.  One shuffle of
    the pressed texts; the ranges come from passes over ids and hashes.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(LEAST)).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "doc_id", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(keyed, tasks * parts_per_task)
    keys, ties = np.array([k for k, _ in bounds], dtype=np.int64), [t for _, t in bounds]

    def part_of(k: np.ndarray, tie: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for i in np.flatnonzero(high > low).tolist():
            low[i] = bisect_left(ties, int(tie[i]), int(low[i]), int(high[i]))
        return (len(keys) - low).astype(np.int32)

    part = F.pandas_udf(lambda k, tie: pd.Series(part_of(k.to_numpy(), tie.to_numpy())), "int")
    # per range its first (largest) key: as many rows as ranges
    heads = {r.part: tuple(r.head) for r in keyed.groupBy(part("k", "tie").alias("part")).agg(F.max(F.struct("k", "tie")).alias("head")).collect()}
    order = sorted(heads)
    before = {heads[at]: order[i - 1] for i, at in enumerate(order)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            k, tie = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            blobs = [press((text or "").encode()) for text in batch.column(3).to_pylist()]
            places = list(enumerate(part_of(k, tie).tolist()))
            copies = [(i, before[key]) for i, key in enumerate(zip(k.tolist(), tie.tolist())) if key in before]
            rows = pa.array([i for i, _ in places + copies], pa.int64())
            arrays = [pa.array([p for _, p in places + copies], pa.int32()), pa.array([False] * len(places) + [True] * len(copies)), *(batch.column(i).take(rows) for i in range(3))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(blobs, pa.binary()).take(rows)], ["part", "sentinel", "k", "tie", "doc_id", "text"])

    rows = keyed.mapInArrow(deal, "part int, sentinel boolean, k long, tie long, doc_id long, text binary")
    return rows.repartition(tasks, "part").sortWithinPartitions("part", "sentinel", F.desc("k"), F.desc("tie"))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """One row per document, with its edited text's fingerprint and both likenesses."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (part, doc_id, blob, text, fingerprint) whose next document isn't known yet
        made: tuple = (None, None, ())  # the last pair of texts, and what came of it

        def row(item: tuple, blob: bytes, text: str, fp: Fingerprint) -> tuple:
            nonlocal made
            _, doc_id, own_blob, own_text, own = item
            if made[:2] != (own_blob, blob):
                changed = edited(own_text, text)
                changed_fp = changed_after(own, changed, len(own_text) - len(own_text) // 3)
                digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                made = own_blob, blob, (len(own_text), digest, render(own), render(changed_fp), likeness(own, changed_fp), likeness(own, fp))
            return doc_id, *made[2]

        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for part, sentinel, doc_id, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if waiting is not None and waiting[2] == blob:
                    text, fp = waiting[3:]
                else:
                    text = unpress(blob).decode()
                    fp = syncmers(text)
                if waiting is not None and waiting[0] == part:
                    out.append(row(waiting, blob, text, fp))
                waiting = None if sentinel else (part, doc_id, blob, text, fp)
            columns = list(zip(*out)) or [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)

    rows = ordered_pairs(docs).select("part", "sentinel", "doc_id", "text")
    return rows.mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) alone."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([render(syncmers(t)) for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")
