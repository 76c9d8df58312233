"""SentencePiece encoding and decoding over a relational lattice.

Words (a run of word-start marks and what follows it) form a relation.  Their
substrings up to the longest piece are exploded and equi-joined to the piece
table, the edges found are grouped by word, and Spark's higher-order `aggregate`
folds a word's edges into its segmentation:

* `viterbi` keeps the best-scored path to each place, as a unigram model asks;
* `merge` replays a BPE model's merges: of the adjacent segments whose union is an
  edge the best-scored (leftmost) becomes one, until none is left.  The scores of a
  BPE model are merge ranks, not log probabilities, so a best path over their sums
  is not what the model encodes.

The most frequent words of the corpus go through the relation once and are
broadcast (`most` entries at most).  Where documents are encoded, any other word is
folded from the same piece table in the task that meets it, so every word of every
text is encoded exactly, and no token is shuffled.  Characters in no piece become
their UTF-8 bytes.

Defined cases
* null or empty text: no ids; any text decodes to itself, but that a literal mark decodes to a blank;
* words of any length are encoded whole (long ones where they are met, by a heap);
* repeated rows and null doc_ids are encoded like others; an empty table gives an empty result;
  other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.llm.common import materialize, small_batches

MARK = "▁"
MOST = 100_000
#: Words up to this length may go through the relation.
WORD_CHARS = 48
#: Words a worker remembers beside the broadcast ones, characters and parts of texts it looks up at once, words it folds at once; speed only.
CACHED_WORDS = 200_000
GROUP_CHARS, GROUP_PARTS, GROUP_WORDS = 1 << 20, 1 << 17, 2048
NORMAL, BYTE = 1, 6
_KEY = 1024
_NEVER = float("inf")


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model file."""

    rows: tuple[tuple[str, int, float], ...]
    first_byte: int
    bpe: bool
    texts: tuple[str, ...]

    @staticmethod
    def load(path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rows = tuple((p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL)
        byte_ids = [i for i, p in enumerate(model.pieces) if p.type == BYTE]
        if byte_ids != list(range(byte_ids[0], byte_ids[0] + 256)):
            raise ValueError("the model needs byte fallback, its bytes in order")
        if model.normalizer_spec.name != "identity" or any(MARK in p.lstrip(MARK) or "\n" in p for p, _, _ in rows):
            raise ValueError("the model normalizes, or has pieces across words")
        return Pieces(rows, byte_ids[0], model.trainer_spec.model_type == 2, tuple(p.piece for p in model.pieces))

    @cached_property
    def table(self) -> dict[str, tuple[int, float]]:
        return {piece: (i, score) for piece, i, score in self.rows}

    @cached_property
    def ranks(self) -> dict[str, float]:
        """Piece -> its score's opposite: the least merges first."""
        return {piece: -score for piece, _, score in self.rows}

    @cached_property
    def merges(self) -> Merges:
        """The pairs of pieces that make a piece."""
        return Merges(self.rows, self.first_byte)

    @cached_property
    def longest(self) -> int:
        return max(len(piece) for piece, _, _ in self.rows)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "piece string, id int, score double")


# the relation


def words_of(text: Column) -> Column:
    """The words of a text in order: marks stand for blanks, one more at the start; line breaks stand alone."""
    marked = F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))
    words = F.regexp_extract_all(marked, F.lit(f"(\n|{MARK}*[^{MARK}\n]+|{MARK}+)"), 1)
    return F.when(F.length(text) > 0, words).otherwise(F.array().cast("array<string>"))


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, edges): a word's pieces as a map from start * 1024 + end to (score, id)."""
    spots = F.sequence(F.lit(1), F.length("word"))
    ends = lambda i: F.sequence(i, F.least(F.length("word"), i + pieces.longest - 1))
    cuts = F.flatten(F.transform(spots, lambda i: F.transform(ends(i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    cut = words.select("word", F.explode(cuts).alias("cut")).select(
        "word", ((F.col("cut.i") - 1) * _KEY + F.col("cut.j")).alias("at"), F.substring("word", F.col("cut.i"), F.col("cut.j") - F.col("cut.i") + 1).alias("piece")
    )
    # the piece table has a fixed size, that of the vocabulary file
    edges = cut.join(F.broadcast(pieces.frame(words.sparkSession)), "piece")
    entry = F.struct("at", F.struct("score", "id").alias("edge"))
    grouped = edges.groupBy("word").agg(F.map_from_entries(F.collect_list(entry)).alias("edges"))
    nothing = F.expr("map_from_entries(cast(array() as array<struct<at:int,edge:struct<score:double,id:int>>>))")
    return words.join(grouped, "word", "left").select("word", F.coalesce("edges", nothing).alias("edges"))


def _edge(edges: Column, start: Column, end: Column) -> Column:
    return F.try_element_at(edges, (start * _KEY + end).cast("int"))


def merge_fold(word: Column, edges: Column) -> Column:
    """The places where a word's segments start and end, by replaying merges."""

    def step(places: Column, _: Column) -> Column:
        union = lambda i: F.struct(
            _edge(edges, F.element_at(places, i), F.element_at(places, i + 2))["score"].alias("score"), (-i).alias("left")
        )
        open_ = F.filter(F.transform(F.sequence(F.lit(1), F.size(places) - 2), union), lambda u: u["score"].isNotNull())
        best = F.array_max(open_)
        joined = F.filter(places, lambda _, j: best.isNull() | (j != -best["left"]))
        return F.when(F.size(places) > 2, joined).otherwise(places)

    start = F.sequence(F.lit(0), F.length(word))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step)


def viterbi_fold(word: Column, edges: Column, longest: int, unknown: float) -> Column:
    """The places along the best-scored path; a character in no piece scores `unknown`."""

    def step(best: Column, j: Column) -> Column:
        def path(i: Column) -> Column:
            score = _edge(edges, i, j)["score"]
            single = F.when(j - i == 1, F.lit(unknown))
            return F.struct((F.element_at(best, i + 1)["score"] + F.coalesce(score, single)).alias("score"), (-i).alias("from"))

        paths = F.filter(F.transform(F.sequence(F.greatest(j - longest, F.lit(0)), j - 1), path), lambda p: p["score"].isNotNull())
        return F.concat(best, F.array(F.array_max(paths)))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("from")))
    best = F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step)
    back = lambda places, _: F.when(
        F.element_at(places, 1) == 0, places
    ).otherwise(F.concat(F.array(-F.element_at(best, F.element_at(places, 1) + 1)["from"]), places))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), F.array(F.length(word)), back)


def ids_along(word: Column, edges: Column, places: Column, first_byte: int) -> Column:
    """The ids of the segments between places; what is no piece gives bytes."""

    def segment(i: Column) -> Column:
        start, end = F.element_at(places, i), F.element_at(places, i + 1)
        digits = F.hex(F.substring(word, start + 1, end - start).cast("binary"))
        raw = F.transform(
            F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1),
            lambda k: F.conv(F.substring(digits, k * 2 + 1, F.lit(2)), 16, 10).cast("int") + first_byte,
        )
        known = _edge(edges, start, end)["id"]
        return F.when(known.isNotNull(), F.array(known)).otherwise(raw)

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(places) - 1), segment))


def encode_words(words: DataFrame, pieces: Pieces, fold: str | None = None) -> DataFrame:
    """(word, ids) of distinct words (a `word` column, marks and all, of 1 to 1023 characters), by the relation alone."""
    word, edges = F.col("word"), F.col("edges")
    if (fold or ("merge" if pieces.bpe else "viterbi")) == "merge":
        places = merge_fold(word, edges)
    else:
        places = viterbi_fold(word, edges, pieces.longest, min(s for _, _, s in pieces.rows) - 10.0)
    found = lattice(words, pieces).withColumn("places", places)
    return found.select("word", ids_along(word, edges, F.col("places"), pieces.first_byte).alias("ids"))


# the same fold for words met in a task

_SPLIT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


def fold_word(word: str, pieces: Pieces) -> list[int]:
    """The ids of one word by the merge fold."""
    ranks, parts = pieces.ranks, list(word)
    if len(parts) <= WORD_CHARS:
        get = ranks.get
        unions = [get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while unions and (best := min(unions)) != _NEVER:
            i = unions.index(best)  # the leftmost of the best
            parts[i] += parts.pop(i + 1)
            del unions[i]
            if i < len(unions):
                unions[i] = get(parts[i] + parts[i + 1], _NEVER)
            if i:
                unions[i - 1] = get(parts[i - 1] + parts[i], _NEVER)
    else:
        parts = _fold_long(parts, pieces.table)
    out: list[int] = []
    for part in parts:
        edge = pieces.table.get(part)
        out += [edge[0]] if edge else [pieces.first_byte + b for b in part.encode("utf-8", "replace")]
    return out


def _fold_long(parts: list[str], table: dict[str, tuple[int, float]]) -> list[str]:
    """As above with a heap of candidate merges and a linked list of segments."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (edge := table.get(parts[i] + parts[j])):
            heapq.heappush(heap, (-edge[1], i, j, parts[i] + parts[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, union = heapq.heappop(heap)
        if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != union:
            continue  # one of the two has become part of another
        parts[i], parts[j] = union, ""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [part for part in parts if part]


class Merges:
    """Folds many words at once: pieces are numbered by rank, and a hashed table tells the piece that two pieces make."""

    def __init__(self, rows: tuple[tuple[str, int, float], ...], first_byte: int):
        self.first_byte = first_byte
        ranked = sorted(rows, key=lambda row: -row[2])
        number = {piece: i for i, (piece, _, _) in enumerate(ranked)}
        self.none = len(ranked)  # the number of what is no piece
        self.ids = np.array([*(i for _, i, _ in ranked), 0], np.int32)
        chars = {ord(piece): i for piece, i in number.items() if len(piece) == 1}
        self.of_char = np.full(max(chars, default=0) + 2, self.none, np.int64)  # the last place: any higher character
        self.of_char[list(chars)] = list(chars.values())
        pairs = [
            (number[piece[:k]] * (self.none + 1) + number[piece[k:]], i)
            for piece, i in number.items()
            for k in range(1, len(piece))
            if piece[:k] in number and piece[k:] in number
        ]
        scores = Counter(score for _, _, score in rows)
        tied = [re.escape(piece) for piece, _, score in rows if scores[score] > 1 and len(piece) > 1]
        self.tied = re.compile("|".join(tied)) if tied else None  # pieces whose number is no rank
        keys, made = np.array(pairs, np.int64).reshape(-1, 2).T
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.made = np.full(len(self.keys), self.none, np.int32)
        at, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):  # the first to claim an empty slot has it, the rest try the next slot
            _, first = np.unique(at[waiting], return_index=True)
            first = first[self.keys[at[waiting[first]]] < 0]
            won = waiting[first]
            self.keys[at[won]], self.made[at[won]] = keys[won], made[won]
            waiting = np.delete(waiting, first)
            at[waiting] = (at[waiting] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def union(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each two pieces make, or `none`."""
        keys = left * (self.none + 1) + right
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.made[at], np.int32(self.none))
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            at[more] = (at[more] + 1) % len(self.keys)
            there = self.keys[at[more]]
            same = there == keys[more]
            out[more[same]] = self.made[at[more[same]]]
            more = more[~same & (there >= 0)]
        return out

    def fold(self, words: list[str]) -> list[bytes | None]:
        """The packed ids of each word by the merge fold; None for a word that holds a piece of tied score."""
        lengths, text = np.fromiter(map(len, words), np.int64, len(words)), "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        stride = int(lengths.max()) + 2  # a place without a piece on either side
        spots = np.arange(stride)
        segment = (spots > 0) & (spots <= lengths[:, None])
        piece = np.full(segment.shape, self.none, np.int64)
        piece[segment] = self.of_char[np.minimum(codes, len(self.of_char) - 1)]
        strange = ((piece == self.none) & segment).any(axis=1).tolist()
        ranked = np.ones(len(words), bool)
        if self.tied and self.tied.search(text):
            ranked[:] = [not self.tied.search(word) for word in words]
        unions = np.full(segment.shape, self.none, np.int32)
        pairs = segment[:, :-1] & segment[:, 1:]
        unions[:, :-1][pairs] = self.union(piece[:, :-1][pairs], piece[:, 1:][pairs])
        rows, by_row = np.flatnonzero(ranked), unions
        piece, unions, segment = piece.reshape(-1), unions.reshape(-1), segment.reshape(-1)
        after, before = np.arange(1, len(piece) + 1), np.arange(-1, len(piece) - 1)
        while len(rows):
            left = by_row[rows].argmin(axis=1) + rows * stride  # the leftmost of the best
            best = unions[left]
            found = best < self.none
            rows, left, best = rows[found], left[found], best[found]
            gone = after[left]
            right, ahead = after[gone], before[left]
            piece[left], segment[gone], unions[gone] = best, False, self.none
            after[left], before[right] = right, left
            unions[left] = self.union(best.astype(np.int64), piece[right])
            unions[ahead] = self.union(piece[ahead], best.astype(np.int64))
        segment, piece = segment.reshape(-1, stride), piece.reshape(-1, stride)
        ends = np.cumsum(segment.sum(axis=1)).tolist()
        raw = self.ids[piece[segment]].tobytes()
        out: list[bytes | None] = []
        for row, (word, start, end) in enumerate(zip(words, [0, *ends], ends)):
            if not ranked[row]:
                out.append(None)
            elif strange[row]:
                at = np.flatnonzero(segment[row])
                ids = zip(at.tolist(), piece[row, at].tolist())
                out.append(b"".join(self.packed_bytes(word[i - 1]) if p == self.none else self.ids[p].tobytes() for i, p in ids))
            else:
                out.append(raw[4 * start : 4 * end])
        return out

    def packed_bytes(self, char: str) -> bytes:
        return _pack([self.first_byte + b for b in char.encode("utf-8", "replace")])


def fold_words(words: list[str], pieces: Pieces) -> Iterator[tuple[str, bytes]]:
    """(word, packed ids) as `fold_word` finds them, for words of at least a character."""
    words = sorted(words, key=len)
    many = bisect.bisect_right(words, WORD_CHARS, key=len)
    for i in range(0, many, GROUP_WORDS):
        group = words[i : min(many, i + GROUP_WORDS)]
        for word, ids in zip(group, pieces.merges.fold(group)):
            yield word, _pack(fold_word(word, pieces)) if ids is None else ids
    for word in words[many:]:
        yield word, _pack(fold_word(word, pieces))


class _Words(dict):
    """What stands between two blanks -> its packed ids: a word with its mark left out, or a line break and the unmarked word after it."""

    def __init__(self, known: dict[str, bytes], pieces: Pieces):
        super().__init__()
        self.pieces, self.odd = pieces, _Odd(pieces)
        line_break = self.odd["\n"]
        # all keys of the relation but runs of marks alone, which no key stands for
        self.known = {w[1:] if w[0] == MARK else "\n" + w: raw if w[0] == MARK else line_break + raw for w, raw in known.items() if w.lstrip(MARK)}
        self.update(self.known)

    def __missing__(self, part: str) -> bytes:
        self.learn({part})
        return self[part]

    def learn(self, parts: set[str]) -> None:
        """Fold those of the parts that aren't known yet."""
        new = parts.difference(self)
        if len(self) + len(new) > CACHED_WORDS + len(self.known):
            self.clear()
            self.update(self.known)
            new = parts.difference(self)
        unmarked = {part[1:]: part for part in new if part[0] == "\n"}
        line_break = self.odd["\n"]
        if "" in unmarked:
            self[unmarked.pop("")] = line_break
        self.update((unmarked[word], line_break + ids) for word, ids in fold_words(list(unmarked), self.pieces))
        self.update((word[1:], ids) for word, ids in fold_words([MARK + part for part in new if part[0] != "\n"], self.pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text; the new words of some texts are folded together."""
        out: list[bytes] = []
        held: list[list[str]] = []
        chars = 0

        def settle() -> None:
            self.learn(set().union(*held))
            out.extend(b"".join(map(self.__getitem__, parts)) for parts in held)
            held.clear()

        for text in texts:
            # plain texts: single blanks between words, none at an end or before a line break
            plain = text and MARK not in text and "  " not in text and " \n" not in text and text[0] not in " \n" and text[-1] != " "
            if held and (not plain or chars + len(text) > GROUP_CHARS):
                settle()
                chars = 0
            if not plain:
                out.append(b"".join(map(self.of_word, _SPLIT.findall(MARK + text.replace(" ", MARK)))) if text else b"")
                continue
            parts = text.replace("\n", " \n").split(" ")
            if len(parts) > GROUP_PARTS:
                out.append(b"".join(self._in_groups(parts)))
            else:
                held.append(parts)
                chars += len(text)
        if held:
            settle()
        return out

    def _in_groups(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of a very long text, whose words may be more than should be remembered at once."""
        for i in range(0, len(parts), GROUP_PARTS):
            some = parts[i : i + GROUP_PARTS]
            self.learn(set(some))
            yield b"".join(map(self.__getitem__, some))

    def of_word(self, word: str) -> bytes:
        if word[0] == MARK and len(word) > 1 and word[1] != MARK:
            return self[word[1:]]
        return self.odd[word]


class _Odd(dict):
    """Words that no part stands for, as they are: several marks, no mark, a line break."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHED_WORDS // 8:
            self.clear()
        raw = self[word] = _pack(fold_word(word, self.pieces))
        return raw


def _pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def frequent_words(docs: DataFrame, pieces: Pieces, most: int = MOST) -> DataFrame:
    """(word, ids) of the `most` most frequent words over all texts, of fewer than WORD_CHARS characters and met twice.

    A histogram of the counts in eighths of a power of two tells the level where the room ends;
    of that level's words those with the least hashes are taken.
    """
    # a part is what follows a blank (the word's mark) or, with a line break before it, what follows a line break
    parts = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" \n")), " "), lambda part: (F.length(part) > 0) & (F.length(part) < WORD_CHARS))
    counted = docs.select(F.explode(parts).alias("part")).groupBy("part").count().where("count > 1 and part != '\n'")
    word = F.when(F.startswith("part", F.lit("\n")), F.substring("part", 2, WORD_CHARS)).otherwise(F.concat(F.lit(MARK), "part"))
    words = materialize(counted.select(word.alias("word"), F.floor(F.log2("count") * 8).alias("level")), "words")
    levels = words.groupBy("level").count().orderBy(F.desc("level")).collect()  # some hundreds at most
    room, least = most, None
    for row in levels:
        least = row["level"]
        if row["count"] >= room:
            break
        room -= row["count"]
    if least is None:
        top = words.select("word")
    else:
        last = words.where(F.col("level") == least).orderBy(F.xxhash64("word"), "word").limit(room)
        top = words.where(F.col("level") > least).select("word").union(last.select("word"))
    return materialize(encode_words(top, pieces, "merge"), "word-ids")


def encode(docs: DataFrame, model_path: str, most: int = MOST, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): each text's ids; with `decoded` also the text that the ids decode to, by the same worker."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = Pieces.load(model_path)
    if not pieces.bpe:
        raise ValueError("documents are encoded with BPE models; for others use encode_words")
    # `most` rows at most
    known = {row.word: _pack(row.ids) for row in frequent_words(docs, pieces, most).toLocalIterator()}
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, known, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_words(shared)
        meant = _meanings(words.pieces) if decoded else None
        for batch in batches:
            raw = words.encode([text or "" for text in batch.column(1).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))
            out = {"doc_id": batch.column(0), "ids": ids}
            if decoded:
                out["text"] = _said(ids, meant)
            yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + (", text string" if decoded else ""))


_memo: dict[str, _Words] = {}


def _worker_words(shared) -> _Words:
    """One memory of words per worker and broadcast, by the name that `encode` gave it."""
    key, known, pieces = shared.value
    if key not in _memo:
        _memo.clear()
        _memo[key] = _Words(known, pieces)
    return _memo[key]


def _meanings(pieces: Pieces) -> pa.Array:
    """The bytes that each id stands for."""
    parts = [text.replace(MARK, " ").encode() for text in pieces.texts]
    parts[pieces.first_byte : pieces.first_byte + 256] = [bytes([b]) for b in range(256)]
    return pa.array(parts, pa.large_binary())


def _said(ids: pa.ListArray, meant: pa.Array) -> pa.Array:
    """The texts of lists of ids."""
    said = meant.take(ids.values)
    ends, raw = np.frombuffer(said.buffers()[1], np.int64, said.offset + len(said) + 1)[said.offset :], memoryview(said.buffers()[2] or b"")
    edges = ends[ids.offsets.to_numpy()].tolist()
    return pa.array([str(raw[i:j], "utf-8", "replace")[1:] for i, j in zip(edges, edges[1:])], pa.string())


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, ids): the texts that were encoded."""
    spark = encoded.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Pieces.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meant = _meanings(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _said(batch.column(1), meant)], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
