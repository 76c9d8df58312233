"""The corpus pipeline: quality, line dedup, near dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.llm import line_dedup, packing, pii, quality, simhash
from rillworks.llm.common import materialize
from rillworks.llm.queries import pii_key, tokenizer_path


def _counted(out: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines."""
    return _counted(line_dedup.dedup_documents(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the document with the smallest doc_id."""
    return simhash.keep_one(docs)


def without_names(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put pseudonyms in place of personal values."""
    return _counted(pii.pseudonymize_documents(docs, pii_key(spark)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece, with its ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", fresh_lines),
    ("simhash near-dedup", one_of_each),
    ("pii", without_names),
    ("packing", packed),
]

#: The classifier's scores can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
