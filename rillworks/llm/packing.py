"""Packing: concatenate and cut, by two-pass prefix sums over partition totals.

Pass one tokenizes every document once and stores its ids with the partition
that made them and the ids before it in that partition.  The partitions' totals
(one row each) are summed up into bases, so a document's global offset is
base + offset in its partition.  Pass two cuts at multiples of the window; a
document that crosses a window's edge gives one boundary record per window.
No pass shuffles rows, and only the last sequence is short.

Defined cases
* null or empty text: the end id alone;
* documents keep their own rows, so repeated doc_ids or null ones give pieces each;
* texts of any length are encoded whole; an empty table gives no pieces;
* sequence numbers follow the order of partitions and of rows in them.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillworks.llm.common import materialize, quiet_threads, small_batches

WINDOW = 4096
END_ID = 2
#: Words a worker remembers; past that it starts anew.  Speed only, never the result.
CACHED_WORDS = 800_000

#: The splitting pattern of the tokenizer file, written out for Latin-1 text.
LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s\x85\xa0{LETTER}{NUMBER}]+"
#: Texts on which lower-casing, composition and white space have no special cases.
PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xff]*"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Words(dict):
    """Word -> its ids as little-endian 16-bit bytes, encoded when first met."""

    def __init__(self, model, cached: int):
        super().__init__()
        self.model, self.cached, self.letters = model, cached, byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.cached:
            self.clear()
        letters = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        raw = self[word] = array("H", [token.id for token in self.model.tokenize(letters)]).tobytes()
        return raw


class Encoder:
    """The tokenizer's ids, as bytes, with a memory of words.

    On Latin-1 text without special tokens a text's ids are those of its words,
    each encoded alone by the tokenizer's model.  Any other text goes to the
    tokenizer whole.
    """

    def __init__(self, file: bytes, cached: int = CACHED_WORDS):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(file)
        if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) > 0xFFFF or sys.byteorder != "little":
            raise ValueError("ids must fit in 16 bits, and the machine be little-endian")
        self.words = _Words(self.tokenizer.model, cached)
        self.split, self.plain = re.compile(PIECES), re.compile(PLAIN)

    def encode(self, texts: list[str]) -> list[bytes]:
        get, out = self.words.__getitem__, []
        for text in texts:
            if "<|" not in text and self.plain.fullmatch(text):
                out.append(b"".join(map(get, self.split.findall(text.lower()))))
            else:
                out.append(array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
        return out


_memo: dict[str, Encoder] = {}


def _worker_encoder(shared) -> Encoder:
    """One per worker process and tokenizer file, known by the file's digest."""
    digest, file = shared.value
    if digest not in _memo:
        _memo.clear()
        _memo[digest] = Encoder(file)
    return _memo[digest]


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(part, doc_id, before, n_tokens, ids): ids as little-endian 16-bit, with the end id; `before` within the partition."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, "rb") as opened:
        file = opened.read()
    # the tokenizer's file, a few MB, goes to the workers: they need not have it at the driver's path
    shared = spark.sparkContext.broadcast((hashlib.sha256(file).hexdigest(), file))
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, encode = TaskContext.get().partitionId(), 0, _worker_encoder(shared).encode
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            ids = [raw + end for raw in encode(texts)]
            sizes = np.array([len(raw) // 2 for raw in ids], dtype=np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part)), batch.column(0), pa.array(starts), pa.array(sizes), pa.array(ids, pa.binary())],
                ["part", "doc_id", "before", "n_tokens", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "part long, doc_id long, before long, n_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, 16-bit)."""
    spark = docs.sparkSession
    coded = materialize(encode_documents(docs, tokenizer_path, end_id), "packing-ids")
    totals = coded.groupBy("part").agg(F.sum("n_tokens").alias("total")).orderBy("part").collect()  # a row per partition
    sums = itertools.accumulate((row.total for row in totals), initial=0)
    bases = spark.sparkContext.broadcast({row.part: base for row, base in zip(totals, sums)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            base = bases.value
            for part, doc_id, before, n, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                at, start, wide = base[part] + before, 0, np.frombuffer(raw, "<u2").astype("<u4")
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = wide[start : start + length]
                    ids = piece.astype("<u2").tobytes() if with_ids else None
                    rows.append((doc_id, start, length, zlib.crc32(piece.tobytes()), n, sequence, offset, ids))
                    start += length
            columns = list(zip(*rows)) or [()] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, NAMES[: len(arrays)])

    schema = ", ".join(f"{n} long" for n in NAMES[:7]) + ", ids binary" * with_ids
    return coded.select("part", "doc_id", "before", "n_tokens", "ids").mapInArrow(cut, schema)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def padding(pieces: pd.DataFrame, window: int = WINDOW) -> int:
    """Pad ids that the packed sequences need."""
    filled = pieces.groupby("sequence_id")["length"].sum()
    return int((window - filled).sum())
