"""Toxicity by weak supervision.

Many weak voters look at a text: one per word of a seed lexicon, one per word or stem
that labelled text suggests, and patterns (several insults, an insult beside "you",
shouting, symbols, long clean text).  A generative label model learns from their
votes alone how often each fires on toxic and on clean text; the correlation that
is left between two voters within the classes makes them share their weight.  Its
posteriors are the labels a linear classifier over the voters and common words is
trained on; labels of the training folds then set the scale of its probabilities.

The lexicon, the label model and the classifier are fitted on a bounded sample: of the
`max_rows` labelled ids of the training folds with the smallest hash, one row each.

Defined cases
* null, empty or blank text: no voter fires, and it has a score like any other;
* rows with a null label are ignored, several labels of a document are averaged;
* no labelled row: voters of the seed lexicon alone decide (score 0.9 if one fires, else 0.05);
* repeated rows and rows with a null doc_id are scored like others; a null id is in no fold and
  is never learnt from; of rows that share an id the least text is learnt from;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillworks.llm.common import materialize_at, remove_path, small_batches
from rillworks.llm.quality import labelled_sample

FOLDS = 4
HELD_FOLD = 2
THRESHOLD = 0.3
MAX_ROWS = 8000
#: Words of the classifier beside the voters, and words labels may add to the lexicon.
MAX_WORDS = 1000
MAX_LEARNT = 40

#: A small seed lexicon of insults.
SEED_LEXICON = (
    "idiot", "moron", "stupid", "dumb", "fool", "loser", "clown", "scum", "trash", "garbage",
    "worthless", "pathetic", "disgusting", "filthy", "ugly", "vermin", "imbecile",
)

END = "$"
STEMS = (4, 8)
#: Words a worker remembers; speed only.
CACHED_WORDS = 500_000

_WORD = re.compile(r"\w+")
_YOU = frozenset(("you", "your", "youre", "u"))


class _Memo(dict):
    """Word -> the lexicon entry it matches, or -1; remembers words for speed only."""

    def __init__(self, entries: list[str]):
        super().__init__()
        self.whole = {e[:-1]: i for i, e in enumerate(entries) if e.endswith(END)}
        self.stems = {e: i for i, e in enumerate(entries) if not e.endswith(END)}
        self.lengths = sorted({len(stem) for stem in self.stems}, reverse=True)

    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        found = self.whole.get(word, -1)
        for length in self.lengths if found < 0 else ():
            if (found := self.stems.get(word[:length], -1)) >= 0:
                break
        self[word] = found
        return found


class Voters:
    """Turns a text into votes: 1 where a voter fires.  An entry ending in "$" is a whole word, others are stems."""

    PATTERNS = ("any entry", "several hits", "dense hits", "several entries", "hit near you", "shouting", "symbols", "long and clean")

    def __init__(self, seed: tuple[str, ...] = SEED_LEXICON, learnt: tuple[str, ...] = ()):
        self.entries = list(dict.fromkeys([*(word + END for word in seed), *learnt]))
        self.names = [*self.entries, *self.PATTERNS]
        self._memo = _Memo(self.entries)

    def __reduce__(self):
        return _voters, (self.entries,)

    def votes(self, text: str | None) -> tuple[np.ndarray, list[str]]:
        text = text or ""
        words = _WORD.findall(text.lower())
        codes = np.fromiter(map(self._memo.__getitem__, words), np.int64, len(words))
        hits = np.flatnonzero(codes >= 0)
        out = np.zeros(len(self.names), dtype=np.int8)
        base = len(self.entries)
        out[codes[hits]] = 1
        if len(hits):
            near = (words[j] in _YOU for i in hits.tolist() for j in range(max(0, i - 3), min(len(words), i + 4)))
            out[base : base + 5] = 1, len(hits) > 1, len(hits) * 100 > len(words), out[:base].sum() > 1, any(near)
        out[base + 5] = "!!" in text
        out[base + 6] = "***" in text or "$$$" in text
        out[base + 7] = not len(hits) and len(words) > 100
        return out, words


def _voters(entries: list[str]) -> Voters:
    return Voters((), tuple(entries))


def learn_lexicon(counts: list[tuple[str, int, float]], n: int, n_toxic: float, most: int = MAX_LEARNT) -> tuple[str, ...]:
    """Words and stems found mostly in toxic text; `counts` holds (entry, documents, toxic documents).

    An entry needs 2 in 100 toxic documents (and 5), and 7 in 10 of its documents
    toxic.  Of entries of which one extends the other the better stays.
    """
    found = []
    for entry, n_entry, n_bad in counts:
        if n_bad >= max(5, 0.02 * n_toxic) and n_bad >= 0.7 * n_entry:
            odds = math.log((n_bad + 0.5) / (n_toxic + 1)) - math.log((n_entry - n_bad + 0.5) / (n - n_toxic + 1))
            if odds > 1.5:
                found.append((odds * math.sqrt(n_bad), entry))
    chosen: list[str] = []
    for _, entry in sorted(found, key=lambda x: (-round(x[0], 9), -len(x[1]), x[1])):
        word = entry.removesuffix(END)
        if not any(word.startswith(c.removesuffix(END)) or c.removesuffix(END).startswith(word) for c in chosen):
            chosen.append(entry)
    return tuple(chosen[:most])


@dataclass
class LabelModel:
    """P(fires | toxic), P(fires | clean), the share of toxic text, and each voter's share of weight."""

    toxic: np.ndarray
    clean: np.ndarray
    prior: float
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.toxic / self.clean)
        off = np.log((1 - self.toxic) / (1 - self.clean))
        z = math.log(self.prior / (1 - self.prior)) + votes @ (self.weight * on) + (1 - votes) @ (self.weight * off)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> LabelModel:
    """Expectation maximisation from the votes alone; `start` is the first guess at the posterior.

    Each round measures, with the classes taken out, the correlation of every pair
    of voters; a voter's weight is one over the sum of its squared correlations.
    """
    votes = votes.astype(np.float64)
    q = start.astype(np.float64)
    for _ in range(rounds):
        a, b = q.sum() + 1e-9, (1 - q).sum() + 1e-9
        toxic = np.clip((q @ votes + 0.05) / (a + 1), 1e-3, 1 - 1e-3)
        clean = np.clip(((1 - q) @ votes + 0.05) / (b + 1), 1e-3, 1 - 1e-3)
        rest = votes - np.outer(q, toxic) - np.outer(1 - q, clean)
        cov = rest.T @ rest / max(1, len(votes))
        sd = np.sqrt(np.diag(cov)) + 1e-6
        weight = 1 / np.maximum(1, ((cov / np.outer(sd, sd)) ** 2).sum(axis=1))
        model = LabelModel(toxic, clean, float(np.clip(a / (a + b), 0.01, 0.99)), weight)
        new = model.posterior(votes)
        if np.abs(new - q).max() < 1e-4:
            break
        q = new
    return model


def train_linear(x: np.ndarray, y: np.ndarray, penalty: float = 2e-3, steps: int = 300) -> np.ndarray:
    """Logistic regression (last weight: bias) by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w = np.zeros(x.shape[1])
    ahead, rate = w.copy(), 4 / (np.linalg.norm(x, ord=2) ** 2 / max(1, len(x)) + 4 * penalty)
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        g = x.T @ (p - y) / max(1, len(x)) + penalty * np.append(ahead[:-1], 0)
        new = ahead - rate * g
        ahead, w = new + step / (step + 3) * (new - w), new
    return w


@dataclass
class ToxicityModel:
    voters: Voters
    words: dict[str, float]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, text: str | None) -> float:
        votes, words = self.voters.votes(text)
        z = float(votes @ self.weights) + self.bias
        for word in sorted(self.words.keys() & set(words)):
            z += self.words[word]
        return z

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.logit(text) + self.shift))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_fold: int = HELD_FOLD, max_rows: int = MAX_ROWS) -> ToxicityModel:
    small_batches(docs.sparkSession)
    sample, path = labelled_sample(docs, labels, label, folds, held_fold, max_rows)
    texts = sample.dropDuplicates(["text"])  # a text copied often says no more than once
    n, n_toxic = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n:
        remove_path(docs.sparkSession, path)
        hits = np.zeros(len(Voters().names))
        hits[len(Voters().entries)] = math.log(0.9 / 0.1) - math.log(0.05 / 0.95)
        return ToxicityModel(Voters(), {}, hits, math.log(0.05 / 0.95))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1))

    def entries(word):
        cuts = F.filter(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[1])), lambda k: k <= F.length(word))
        return F.concat(F.array(F.concat(word, F.lit(END))), F.transform(cuts, lambda k: F.substring(word, F.lit(1), k)))

    counted = (
        texts.select("y", F.explode(F.array_distinct(F.flatten(F.transform(words, entries)))).alias("entry"))
        .groupBy("entry")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad"))
        .where("n >= 5")
    )
    counted, counted_path = materialize_at(counted, "entries")
    # of the sample's entries the MAX_WORDS most frequent words, and those most in toxic text
    frequent = counted.where(F.col("entry").endswith(END)).orderBy(F.desc("n"), "entry").limit(MAX_WORDS).collect()
    marked = counted.where("bad >= 5 and bad >= 0.7 * n").orderBy(F.desc("bad"), "entry").limit(100 * MAX_LEARNT).collect()
    learnt = learn_lexicon([tuple(r) for r in marked], n, n_toxic)
    voters = Voters(SEED_LEXICON, learnt)
    common = [r.entry[:-1] for r in frequent if r.entry not in voters.entries]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {word: i for i, word in enumerate(common)}
        for batch in batches:
            seen = [voters.votes(text) for text in batch.column(1).to_pylist()]
            votes = pa.array([v.tolist() for v, _ in seen], pa.list_(pa.int8()))
            has = pa.array([sorted({place[w] for w in words if w in place}) for _, words in seen], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), votes, has], ["doc_id", "y", "votes", "has"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(look, "doc_id long, y double, votes array<byte>, has array<int>").collect()  # max_rows rows
    remove_path(docs.sparkSession, path)
    remove_path(docs.sparkSession, counted_path)
    rows.sort(key=lambda row: (row.doc_id, row.y, row.votes, row.has))
    votes, y = np.array([row.votes for row in rows]), np.array([row.y for row in rows])
    start = np.where(votes[:, len(voters.entries)] > 0, 0.9, 0.05)
    posterior = fit_label_model(votes, start).posterior(votes)
    x = np.zeros((len(rows), len(voters.names) + len(common)), dtype=np.float32)
    x[:, : len(voters.names)] = votes
    for i, row in enumerate(rows):
        x[i, len(voters.names) + np.array(row.has, dtype=np.int64)] = 0.3  # common words: weaker than voters
    w = train_linear(x, posterior)
    model = ToxicityModel(
        voters, {word: 0.3 * float(c) for word, c in zip(common, w[len(voters.names) : -1])}, w[: len(voters.names)].astype(np.float64), float(w[-1])
    )
    z = (x @ w[:-1] + w[-1]).astype(np.float64)
    if y.min() < y.max():
        slope, shift = train_linear(z[:, None], y, penalty=1e-6, steps=2000)
        if slope > 0:
            model.slope, model.shift = float(slope), float(shift)
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(row, score, predicted): the columns of `docs` in a struct."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(text) for text in batch.column(0).field("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
