"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words hash into a fixed table.  Each slot has a sparse random index vector; a
slot's context vector is the sum of the index vectors around its occurrences in
the labelled sample.  A document is the mean of both over all of its words, and
a tanh layer and a logistic layer in numpy score it.  A held-back part of the
sample sets the temperature of the probabilities.

The model is fitted on a bounded sample: of the `max_rows` labelled ids of the
training folds with the smallest hash, one row each.  The score sees the text alone.

Defined cases
* null, empty or blank text: the zero vector, which has a score like any other;
* rows with a null label are ignored, several labels of a document are averaged;
* no labelled row, or labels of one kind only: every score is the smoothed base rate;
* repeated rows and rows with a null doc_id are scored like others; a null id is in no fold
  and is never learnt from; of rows that share an id the least text is learnt from;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillworks.llm.common import fold, materialize_at, remove_path, small_batches

FOLDS = 5
THRESHOLD = 0.3
MAX_ROWS = 6000
SLOTS = 1 << 15
WIDTH = 64
NONZERO = 6
REACH = 2
HIDDEN = 32
#: Words a worker remembers the slots of; speed only.
CACHED_WORDS = 500_000

_WORD = re.compile(r"\w+|[^\w\s]+")
#: Slots of word kinds rather than words.
_AGAIN, _CAPITALS, _NUMBER = 0, 1, 2


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        if len(word) > 1 and word.isupper():
            slot = _CAPITALS
        elif word[0].isdigit():
            slot = _NUMBER
        else:
            slot = 3 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (SLOTS - 3)
        self[word] = slot
        return slot


_slots = _Slots()


def word_slots(text: str | None) -> np.ndarray:
    """The slots of a text's words; a word that repeats its predecessor is the word "again"."""
    words = _WORD.findall(text or "")
    at = np.fromiter(map(_slots.__getitem__, words), np.int64, len(words))
    again = np.zeros(len(at), dtype=bool)
    again[1:] = at[1:] == at[:-1]
    again &= at > _NUMBER
    return np.where(again, _AGAIN, at)


def index_vectors(seed: int = 7) -> np.ndarray:
    """SLOTS x WIDTH of -1, 0 and 1, `NONZERO` of them not 0."""
    rng = np.random.default_rng(seed)
    out = np.zeros((SLOTS, WIDTH), dtype=np.float32)
    spots = np.argsort(rng.random((SLOTS, WIDTH)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, spots, rng.choice([-1.0, 1.0], (SLOTS, NONZERO)).astype(np.float32), axis=1)
    return out


def context_sums(texts: Iterator[str | None], index: np.ndarray) -> np.ndarray:
    """Per slot, the sum of the index vectors within `REACH` words of its occurrences."""
    out = np.zeros(index.shape, dtype=np.float64)
    for text in texts:
        slots = word_slots(text)
        for start in range(0, len(slots), 20_000):
            for gap in range(1, REACH + 1):
                one = slots[start : start + 20_000]  # pairs that begin here, so that each counts once
                two = slots[start + gap : start + gap + len(one)]
                one = one[: len(two)]
                for here, there in ((one, two), (two, one)):
                    if len(here):
                        order = np.argsort(here, kind="stable")
                        ids, first = np.unique(here[order], return_index=True)
                        out[ids] += np.add.reduceat(index[there[order]], first, axis=0)
    return out


def word_table(index: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Per slot: the context vector at unit length, then the index vector at unit length."""
    norms = np.linalg.norm(context, axis=1, keepdims=True)
    unit = np.divide(context, norms, out=np.zeros_like(context), where=norms > 0)
    return np.hstack([unit, index / np.sqrt(NONZERO)]).astype(np.float32)


def pool(text: str | None, table: np.ndarray) -> np.ndarray:
    """The mean vector of a text's words."""
    slots = word_slots(text)
    if not len(slots):
        return np.zeros(table.shape[1])
    at, counts = np.unique(slots, return_counts=True)
    return (counts @ table[at].astype(np.float64)) / len(slots)


@dataclass
class Network:
    """tanh layer, logistic layer, temperature; `rate` alone if there was nothing to learn."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    rate: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, held: np.ndarray, epochs: int = 60, seed: int = 3) -> Network:
    """Adam on the rows outside `held`, temperature on the rows in it."""
    rng = np.random.default_rng(seed)
    dims = x.shape[1]
    empty = Network(np.zeros(dims), np.ones(dims), np.zeros((dims, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if not len(y) or y.min() == y.max():
        empty.rate = float((y.sum() + 1) / (len(y) + 2))
        return empty
    fit_x, fit_y = (x[~held], y[~held]) if (~held).any() and y[~held].min() < y[~held].max() else (x, y)
    mean, scale = fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-3
    z = (fit_x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(dims), (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 64)):
            a, t = z[rows], fit_y[rows]
            h = np.tanh(a @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) / len(rows)
            dh = np.outer(d, p[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((a.T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if held.any():
        logits, t = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.5), np.log(8), 57))
        loss = [np.mean(np.logaddexp(0, logits / g) - t * logits / g) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class QualityModel:
    table: np.ndarray
    network: Network

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.network.score(np.array([pool(text, self.table) for text in texts]).reshape(len(texts), -1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_fold: int, max_rows: int) -> tuple[DataFrame, str]:
    """(doc_id, text, y) of at most `max_rows` labelled documents outside the held-out fold, written once, and its path."""
    ids = (
        labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_fold))
        .groupBy("doc_id")
        .agg(F.avg(F.col(label).cast("double")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # max_rows ids at most, so the side has a fixed size, and so has the sample: a row per id
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return materialize_at(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), "sample")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_fold: int = 0, max_rows: int = MAX_ROWS) -> QualityModel:
    """Fit on the labelled sample; both passes over it run on the executors."""
    spark = docs.sparkSession
    small_batches(spark)
    sample, path = labelled_sample(docs, labels, label, folds, held_fold, max_rows)
    index = index_vectors()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index_vectors()
        sums = context_sums((text for batch in batches for text in batch.column(0).to_pylist()), own)
        yield pa.RecordBatch.from_arrays([pa.array([sums.astype("<f4").tobytes()])], ["sums"])

    context = np.zeros(index.shape)
    # four tables of fixed size come back
    for row in sample.select("text").repartition(4).mapInArrow(contexts, "sums binary").toLocalIterator():
        context += np.frombuffer(row.sums, "<f4").reshape(index.shape)
    table = word_table(index, context)
    shared = spark.sparkContext.broadcast(table)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pool(text, shared.value).tolist() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(pooled, "doc_id long, y double, x array<double>").collect()  # max_rows rows
    remove_path(spark, path)
    rows.sort(key=lambda row: (row.doc_id, row.y, row.x))
    x = np.array([row.x for row in rows]).reshape(len(rows), table.shape[1])
    y = np.array([row.y for row in rows])
    held = np.array([zlib.crc32(b"held %d" % row.doc_id) % 5 == 0 for row in rows], dtype=bool)
    return QualityModel(table, train(x, y, held))


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of `docs` in a struct `row`, with score and predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(batch.column(0).field("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["row", "score"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject, with their own columns."""
    kept = score(docs, fit(docs, labels, **options)).where("predicted = 1")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
