"""The contract queries over the operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.llm import ann, line_dedup, packing, pii, quality, simhash, spm, syncmers, toxicity, warc
from rillworks.llm.common import fold, scratch_path


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path)


def _scores(scored: DataFrame, folds: int, held_fold: int) -> DataFrame:
    held = F.coalesce(fold(F.col("row.doc_id"), folds) == held_fold, F.lit(False))
    return scored.select(F.col("row.doc_id").alias("doc_id"), held.alias("held_out"), "score", "predicted")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _scores(quality.score(docs, model), quality.FOLDS, 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _scores(toxicity.score(docs, model), toxicity.FOLDS, toxicity.HELD_FOLD)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and the digest of what they decode to."""
    both = spm.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_components(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0"))
    return rows.select("doc_id", digits.alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


#: The setting that holds the secret of the pseudonyms, and the key of tests and examples where it is unset.
KEY_SETTING, EXAMPLE_KEY = "spark.rillworks.pii.key", "an example key"


def pii_key(spark: SparkSession) -> bytes:
    return spark.conf.get(KEY_SETTING, EXAMPLE_KEY).encode()


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(table(spark, sf_dir, "documents"), pii_key(spark))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("new_text").alias("text"), "n_replaced", "kinds")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_neighbours": op4_neighbours,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_syncmers": op6_syncmers,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
}

_SPACE = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
heavy AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= {line_dedup.MIN_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
marked AS (
  SELECT keyed.*, heavy.k IS NOT NULL AND keyed.doc_id <> heavy.last_doc AS dropped
  FROM keyed LEFT JOIN heavy ON keyed.k = heavy.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_BASE32 = "".join(f" || substr('{warc.BASE32}', 1 + ((v >> {s}) & 31), 1)" for s in (15, 10, 5, 0))[4:]

OP2_SQL = f"""
WITH facts AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
owned AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS owner FROM facts)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)), lambda v: {_BASE32}), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM owned
"""

ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op2_warc": OP2_SQL}
