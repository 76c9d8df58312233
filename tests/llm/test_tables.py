"""Line dedup, WARC, packing and nearest neighbours against brute force."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillworks.llm import ann, line_dedup, packing, queries, warc
from rillworks.llm.common import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute_lines(rows, min_chars, min_docs):
    holders = defaultdict(list)
    keys = []
    for at, (i, text) in enumerate(rows):
        keys.append([lower(line).strip("\t\n\x0b\x0c\r ") for line in (text or "").split("\n")])
        for key in set(keys[-1]):
            if len(key) >= min_chars:
                holders[key].append(i)
    out = []
    for (i, text), own in zip(rows, keys):
        keep = []
        for line, key in zip((text or "").split("\n"), own):
            held = holders.get(key, [])
            last = max((h for h in held if h is not None), default=None)
            if not (len(held) >= min_docs and i != last):
                keep.append(line)
        out.append((i, "\n".join(keep), len(own), len(own) - len(keep)))
    return out


LONG = "Éa line of MORE than forty code points, just so you know"


@pytest.mark.parametrize("parts", [1, 3])
def test_line_dedup(spark, tmp_path, parts):
    texts = [LONG, f" {LONG.upper().replace('É', 'É')}\t", f"a\n{LONG}\n\n{LONG}\nb", None, "", "short\nshort", f"{LONG}\n", f"x\n{LONG}", LONG, LONG + "!" * 5]
    texts += [f"own {i}\n{'y' * 39}\n{'z' * 40}" for i in range(6)] + ["\n" * 300 + "\n".join([LONG] * 200)]
    ids = [*range(len(texts) - 2), None, 5]
    rows = list(zip(ids, texts))
    path = str(tmp_path / "docs")
    docs_of(spark, texts, ids).repartition(parts).write.parquet(path)
    docs = spark.read.parquet(path)
    got = line_dedup.dedup_lines(docs, fanout=2).select("row.doc_id", "kept_text", "n_lines", "n_dropped").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_lines(rows, 40, 5), key=key)
    kept = line_dedup.dedup_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert kept.where("text is null").count() == 1


def test_line_dedup_of_nothing_and_of_odd_columns(spark):
    empty = docs_of(spark, []).where("false")
    assert line_dedup.dedup_documents(empty).count() == 0
    odd = docs_of(spark, [LONG] * 6).withColumn("row", F.lit(1)).withColumn("h1", F.lit("x")).withColumn("drops", F.lit(2)).withColumn("a.b", F.lit(3))
    out = line_dedup.dedup_documents(odd)
    assert out.columns == odd.columns
    assert sorted(r.text for r in out.collect()) == [""] * 5 + [LONG]


def test_line_dedup_reads_any_format(spark, tmp_path):
    docs = docs_of(spark, [LONG] * 6 + ["x"] * 3)
    docs.write.partitionBy("lang").json(str(tmp_path / "json"))
    read = spark.read.schema(DOCS).json(str(tmp_path / "json"))
    assert sorted((r.lang, r.text) for r in line_dedup.dedup_documents(read).collect()) == [("en", "")] * 5 + [("en", "x")] * 3 + [("en", LONG)]


def lines_of(batch):
    return [f"line number {n} is long enough to count as a line" for n in range(batch * 3, batch * 3 + 6)]


def test_line_runs_hold_each_key_once(spark):
    runs, seen = line_dedup.LineRuns(spark, fanout=2), set()
    for batch in range(5):
        new = runs.add(line_dedup.summarize(docs_of(spark, lines_of(batch))))
        assert new.count() == len(set(lines_of(batch)) - seen)
        seen |= set(lines_of(batch))
        runs.compact()
    assert [len(level) for level in runs.runs.levels] == [1, 0, 1]
    assert sum(frame.count() for frame in runs.runs.frames()) == len(seen) == 18
    totals = runs.totals()
    assert totals.count() == len(seen)
    assert totals.agg(F.sum("n_docs")).first()[0] == 30
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_line_dedup_rests_on_the_anti_join(spark, monkeypatch):
    """Without it a key's documents are spread over runs, and no run's row reaches the threshold."""
    docs = docs_of(spark, [f"{LONG}\n{i}" for i in range(12)])
    right = line_dedup.dedup_lines(docs, batches=6)
    assert sorted(r.n_dropped for r in right.collect()) == [0] + [1] * 11
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]
    monkeypatch.setattr(line_dedup.LineRuns, "add", lambda self, summary: self.runs.put(summary))
    wrong = line_dedup.dedup_lines(docs, batches=6)
    assert sum(r.n_dropped for r in wrong.collect()) != 11


def test_bitmaps_pass_all_hashes_and_few_others(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"))
    test = line_dedup.bitmap(rows.where("h is not null").limit(2000), "test")
    kept = rows.where(test(F.col("h"))).count()
    assert 2000 <= kept <= 2010
    assert rows.where(line_dedup.bitmap(rows.where("false"), "test")(F.col("h"))).count() == 0


def test_native_line_dedup_has_no_python(spark):
    plan = line_dedup.dedup_lines(docs_of(spark, [LONG] * 6))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "http://d/", "x" * 50_000)]
    rows += [(None, "http://n/", "<p>é</p>"), (2, "http://b2/", "<p>é</p>")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash"))
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages, path)
    got = [tuple(r) for r in warc.read_archive(spark, path).collect()]
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        owner = max(j for j, _, h in rows if (h or "") == (html or "") and j is not None)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((i, len(body), digest, "response" if i == owner else "revisit", None if i == owner else owner))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    for r in warc.reconstruct(spark, path).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1") and bytes(r.record).endswith(b"\r\n\r\n") and b"X" not in fields
        assert int(fields[b"Content-Length"]) == len(rest) - 4
        if fields[b"WARC-Type"] == b"response":
            body = rest[:-4].partition(b"\r\n\r\n")[2]
            assert base64.b32encode(hashlib.sha1(body).digest()) == fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:")


def test_warc_small_payloads_empty_table_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES)
    path = f"file://{tmp_path}/a"
    warc.write_archive(pages, path, min_bytes=3)
    got = {r.page_id: r.refers_to for r in warc.read_archive(spark, path).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}
    warc.write_archive(pages.where("false"), f"file://{tmp_path}/b")
    assert warc.read_archive(spark, f"file://{tmp_path}/b").count() == 0
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"zz"))
    materialize(bad, "bad").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, path).collect()


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["Hello, World's 3rd  day!!", None, "", "İstanbul ΣΑΣ café́ 　x", "don't <|endoftext|> a²½ª", "wörd " * 3000, "x\x0by\x85z", "a" * 3000, "naïve ÷ × ß"]
    docs = docs_of(spark, texts * 2).repartition(3).withColumn("ids", F.lit(0))
    pieces = packing.pack(docs, path, window=64, with_ids=True).toPandas()
    by_id = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts * 2)}
    for doc_id, mine in pieces.groupby("doc_id"):
        mine = mine.sort_values("start")
        ids = np.concatenate([np.frombuffer(b, "<u2") for b in mine["ids"]]).tolist()
        assert ids == by_id[doc_id] and (mine.doc_tokens == len(ids)).all()
        assert mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]]
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert set(pieces.doc_id) == set(by_id)
    for _, s in pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 64
    assert packing.padding(pieces, 64) < 64
    assert packing.pack(docs.where("false"), path).count() == 0


def test_packing_remembers_words_without_changing_ids(spark, small):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = [t.ids for t in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for cached in (800_000, 500):
        with open(path, "rb") as file:
            got = packing.Encoder(file.read(), cached).encode(texts)
        assert [np.frombuffer(b, "<u2").tolist() for b in got] == want


def brute_nearest(rows, every, k):
    out = {}
    for q, v in rows:
        if q % every == 0:
            scored = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_nearest_on_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 2.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1)]
    rows += [(7, [float("inf"), 1.0], 1), (8, [1.0], 1), (9, [], 1), (None, [1.0, 1.0], 1), (20, [1.0, 0.0], 1), (40, [0.0, -1.0], 1)]
    got = ann.nearest(vectors_of(spark, rows).withColumn("score", F.lit("clash"))).orderBy("query_id", "rank").collect()
    fine = [(i, np.array(v)) for i, v, _ in rows if i in (0, 1, 2, 20, 40)]
    want = [(q, r + 1, i, s) for q, near in brute_nearest(fine, 20, 20).items() for r, (i, s) in enumerate(near)]
    assert [tuple(r) for r in got] == want
    assert ann.nearest(vectors_of(spark, rows).where("false")).count() == 0


def test_nearest_of_many_rows_of_one_id(spark):
    rng = np.random.default_rng(7)
    rows = [(0, v.tolist(), 1) for v in rng.normal(size=(300, 8))] + [(i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(200, 8)), 1)]
    rows += [(3, [1.0] * 8, 1)] * 50 + [(5, [2.0] * 8, 1)]
    dealt, subs = ann.blocks_of(ann.usable(vectors_of(spark, rows)), 40)
    sizes = [r["count"] for r in dealt.groupBy("band", "sub").count().collect()]
    assert sum(sizes) == 502 and len(sizes) <= sum(subs.values()) and max(sizes) < 90
    got = ann.nearest(vectors_of(spark, rows), every=100, block=40).collect()
    best = {}
    as_float = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows]
    for q, v in as_float:
        for i, w in as_float if q % 100 == 0 else []:
            if i != q:
                best[q, i] = max(best.get((q, i), -1e9), float(v @ w))
    for q in (0, 100, 200):
        want = sorted(((-s, i) for (a, i), s in best.items() if a == q))[:20]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in mine] == [i for _, i in want] and np.allclose([s for _, _, s in mine], [-s for s, _ in want])


@pytest.mark.parametrize("kind,n,k", [("isotropic", 8192, 20), ("isotropic", 70_000, 20), ("clustered", 16_384, 20), ("copies", 16_384, 20)])
def test_a_block_verifies_few_vectors(kind, n, k):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, 64))
    if kind == "clustered":
        v = rng.normal(size=(80, 64))[rng.integers(0, 80, n)] + 0.6 * v
    if kind == "copies":
        v[: n // 3] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    block, queries = ann.Block(np.arange(n), v), np.arange(0, n, n // 60)
    ids, near, scores = block.search(queries, v[queries], k)
    exact = v[queries] @ v.T
    exact[np.arange(len(queries)), queries] = -9
    least = -np.partition(-exact, k - 1, axis=1)[:, k - 1]
    found = [scores[ids == q] for q in queries]
    assert all(len(s) == k for s in found)
    assert sum((s >= t - 1e-12).sum() for s, t in zip(found, least)) >= 0.95 * k * len(queries)
    assert block.verified <= 0.05 * len(block.vectors) * len(queries)
    # what a query finds doesn't depend on the one before it
    fresh = ann.Block(np.arange(n), v)
    again = [fresh.search(queries[at : at + 1], v[queries[at : at + 1]], k) for at in (50, 3)]
    assert [a[1].tolist() for a in again] == [near[ids == queries[at]].tolist() for at in (50, 3)]


def test_recall_on_the_provided_vectors(spark):
    folder = "/root/testdata/sf0.1"
    if not Path(folder).exists():
        pytest.skip("the provided tables aren't here")
    frame = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    v = np.stack(frame.embedding.to_numpy()).astype(float)
    got = queries.op4_neighbours(spark, folder).toPandas()
    hits, asked = 0, np.flatnonzero(frame.vec_id % 20 == 0)
    for at in asked:
        scores = v @ v[at]
        scores[at] = -9
        best = set(frame.vec_id.iloc[np.argsort(-scores, kind="stable")[:20]])
        hits += len(best & set(got[got.query_id == frame.vec_id.iloc[at]].vec_id))
    assert len(got) == 20 * len(asked) and hits >= 0.9 * len(got)


@pytest.mark.parametrize("kind", ["isotropic", "copies", "norms", "one large"])
def test_nearest_recall(spark, kind):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "copies":
        v[:1000] = v[0]
    if kind == "norms":
        v *= rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    if kind == "one large":
        v[:3] *= 20
    rows = [(i, x.astype(float)) for i, x in enumerate(v)]
    got = ann.nearest(vectors_of(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)]), every=100).toPandas()
    want = brute_nearest(rows, 100, 20)
    hits = 0
    for q, near in want.items():
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, [np.dot(rows[q][1], rows[i][1]) for i in mine.vec_id])
        hits += len(set(mine.vec_id) & {i for i, _ in near})
    assert hits >= 0.9 * 20 * len(want)


def test_schemas_of_the_contract(spark, small):
    want = {
        "op1_line_dedup": "doc_id bigint n_lines bigint n_dropped bigint kept_sha256 string",
        "op2_warc": "page_id bigint payload_bytes bigint payload_digest string record_type string refers_to bigint",
        "op4_neighbours": "query_id bigint rank int vec_id bigint score double",
        "op9_packing": "doc_id bigint start bigint length bigint ids_crc32 bigint doc_tokens bigint sequence_id bigint offset bigint",
    }
    for name, text in want.items():
        names = text.split()
        assert queries.QUERIES[name](spark, small).dtypes == list(zip(names[::2], names[1::2])), name
