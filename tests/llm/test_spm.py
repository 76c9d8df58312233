"""SentencePiece against the library's own encoder, and exact round trips."""

from __future__ import annotations

import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb
from tests.llm.test_tables import docs_of

from rillworks.llm import queries, spm

PATH = queries.tokenizer_path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "\n", "  hello  world\n x ", "Ünïcode ▁mark 日本語 🙂\t\x00 <s> <0x0A>", "a" * 3000, "the the the" * 40, "x\n\n\ny" + " " * 50, "ab" * 60 + " tail"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_documents_encode_as_the_library_does(spark, small, library):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    docs = docs_of(spark, texts + texts[:3]).repartition(3)
    for most in (5, 2000):
        coded = spm.encode(docs.withColumnRenamed("lang", "ids"), PATH, most)
        decoded = spm.decode(coded, PATH).collect()
        assert len(decoded) == len(texts) + 3
        at_once = spm.encode(docs, PATH, most, decoded=True).collect()
        assert sorted(at_once, key=lambda r: r.doc_id) == sorted(decoded, key=lambda r: r.doc_id)
        for r in decoded:
            text = (texts + texts[:3])[r.doc_id] or ""
            assert r.ids == library.encode(text), text[:50]
            assert r.text == library.decode(r.ids)
            if "▁" not in text:
                assert r.text == text
    assert spm.decode(spm.encode(docs.where("false"), PATH), PATH).count() == 0


def test_frequent_words_are_those_counted_most(spark):
    pieces = spm.Pieces.load(PATH)
    texts = ["the cat\nthe dog\n\nthe cat", "a\n" * 3, None, "the " * 5 + "x" * 60, "x" * 60 + " rare\nonce"]
    for most, want in ((100, {"▁the", "▁cat", "the", "a", "▁"} - {"▁"}), (1, {"▁the"}), (2, 2), (0, 0)):
        got = {r.word: r.ids for r in spm.frequent_words(docs_of(spark, texts), pieces, most).collect()}
        assert (set(got) == want) if isinstance(want, set) else len(got) == want
        assert all(ids == spm.fold_word(w, pieces) for w, ids in got.items())


def words(n=300):
    rng = random.Random(6)
    stems = ["th", "er", "tion", "é", "an", "ing", "日", "🙂", "X", "9", "."]
    return sorted({"▁" * rng.choice([0, 1, 1, 1, 3]) + "".join(rng.choice(stems) for _ in range(rng.randrange(1, 9))) for _ in range(n)} | {"▁", "▁▁", "\n"})


def test_merge_fold_of_the_relation(spark, library):
    pieces = spm.Pieces.load(PATH)
    got = {r.word: r.ids for r in spm.encode_words(spark.createDataFrame([(w,) for w in words()], "word string"), pieces).collect()}
    assert got == {w: spm.fold_word(w, pieces) for w in words()}
    for w in words():
        if w.startswith("▁") and "\n" not in w:
            assert got[w] == library.encode(w[1:].replace("▁", " ")) or w == "▁"
        assert spm._fold_long(list(w), pieces.table) == [p for p in _parts(w, pieces)]


def _parts(word, pieces):
    """Segments by merging the best pair again and again."""
    parts = list(word)
    while True:
        found = [(-pieces.table[a + b][1], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in pieces.table]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_viterbi_fold_finds_the_best_path(spark):
    model = pb.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type, model.normalizer_spec.add_dummy_prefix = 1, False
    unigram = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    pieces = spm.Pieces.load(PATH)
    score = {i: s for _, i, s in pieces.rows}
    plain = [w for w in words() if "\n" not in w and not set(w) & {"日", "🙂"}]
    got = {r.word: r.ids for r in spm.encode_words(spark.createDataFrame([(w,) for w in plain], "word string"), pieces, "viterbi").collect()}
    for w in plain:
        assert "".join(pieces.texts[i] for i in got[w]) == w
        assert sum(score[i] for i in got[w]) == pytest.approx(sum(score[i] for i in unigram.encode(w)))


def test_many_words_fold_as_one_does(library):
    """Unknown characters, runs of marks (pieces of tied score), long words, and one character alone."""
    pieces = spm.Pieces.load(PATH)
    rng = random.Random(9)
    alphabet = "ethanisor" * 3 + "Ééß日🙂\x00%#9.▁" + "�"
    many = {"".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(3000)} | set(words()) | {"e", "\x00", "▁", "▁▁▁", "x" * 500}
    got = dict(spm.fold_words(list(many), pieces))
    assert got == {w: spm._pack(spm.fold_word(w, pieces)) for w in many}
    assert dict(spm.fold_words([], pieces)) == {}


def test_a_small_memory_of_words_changes_nothing(monkeypatch, library):
    texts = [" ".join(words(80)).replace("▁", "") + "\nx\n\ny", "plain words\nof a text", "", "  two  blanks ", "\n", " ".join(f"w{i}" for i in range(500))]
    monkeypatch.setattr(spm, "CACHED_WORDS", 20)
    monkeypatch.setattr(spm, "GROUP_PARTS", 7)
    memory = spm._Words({}, spm.Pieces.load(PATH))
    for group_chars in (1, 10_000):
        monkeypatch.setattr(spm, "GROUP_CHARS", group_chars)
        assert memory.encode(texts) == [spm._pack(library.encode(text)) for text in texts]
