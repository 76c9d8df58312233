"""WARC: a content-addressed archive of page records.

An archive is two tables.  `payloads` holds each distinct payload once under its
SHA-256, `headers` one row per record with the record's exact header bytes and
the digest it points to.  Two payloads of one digest are never taken for equal
on trust: length and an independent hash must agree too, or the write fails.
A record is header + payload + CRLF CRLF (a revisit: header + CRLF CRLF), which
`reconstruct` joins together again.

Defined cases
* null html: the empty payload, which is deduplicated like any other;
* payloads below `min_bytes`: every record is a response;
* equal payloads: the record with the largest page_id is the response, the others
  revisit it; rows that repeat that page_id are all responses; where all page_ids
  are null, all are responses, and a null page_id is below every other;
* null url: no WARC-Target-URI; line breaks in a url are percent-encoded;
* an empty table gives an empty archive; other columns are ignored.

Pages carry no time or HTTP header, so every record has the date DATE and a plain header of status,
type and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
DATE = "2024-01-01T00:00:00Z"
RECORD = "urn:rillworks:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hex string of 40 digits: 60, 60 and 40 bits become numbers to the base 32, whose digits are renamed."""
    part = lambda at, digits: F.lpad(F.conv(F.substring(hex_digest, at, digits), 16, 32), digits * 4 // 5, "0")
    return F.translate(F.concat(part(1, 15), part(16, 15), part(31, 10)), DIGITS, BASE32)


def _digests(payload: Column) -> list[Column]:
    return [
        F.unhex(F.sha2(payload, 256)).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
        F.xxhash64(payload).alias("check"),
    ]


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def _header() -> Column:
    """The exact header bytes of a record, as text: WARC fields, a blank line, the HTTP fields, a blank line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = F.col("record_type") == "revisit"
    id_of = lambda c: F.concat(F.lit(f"<{RECORD}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(CRLF * 2),
    )
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", id_of(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", id_of(F.col("owner"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(
            F.lit("")
        ),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record per row of `pages` (page_id, url, html) to the archive at `path`."""
    spark = pages.sparkSession
    payload = _payload()
    same = (F.col("least_size") == F.col("size")) & (F.col("least_check") == F.col("check"))
    (
        pages.select("page_id", payload.alias("payload"), *_digests(payload))
        .groupBy("digest")
        .agg(
            F.first("payload").alias("payload"),
            F.max("page_id").alias("owner"),
            F.max("size").alias("size"),
            F.min("size").alias("least_size"),
            F.max("check").alias("check"),
            F.min("check").alias("least_check"),
        )
        .select(
            "digest",
            F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("payloads of one digest differ"))).alias("payload"),
            base32(F.sha1("payload")).alias("sha1"),
            "owner",
            "size",
        )
        .write.option("compression", "zstd")
        .parquet(f"{path}/payloads")
    )
    owners = spark.read.parquet(f"{path}/payloads").select("digest", "owner", "size", "sha1")
    facts = pages.select("page_id", "url", F.unhex(F.sha2(payload, 256)).alias("digest"))
    response = F.col("page_id").eqNullSafe(F.col("owner")) | (F.col("size") < min_bytes)
    (
        facts.join(owners, "digest")
        .withColumn("record_type", F.when(response, "response").otherwise("revisit"))
        .select("page_id", "digest", _header().cast("binary").alias("header"))
        .write.option("compression", "zstd")
        .parquet(f"{path}/headers")
    )


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    headers = spark.read.schema("page_id long, digest binary, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest binary, payload binary, sha1 string, owner long, size long").parquet(f"{path}/payloads")
    return headers, payloads


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, parsed from its header and held against the stored payload.

    A payload whose bytes no longer have the digest it is stored or recorded
    under fails the read.
    """
    headers, payloads = _tables(spark, path)
    stored = payloads.select(
        "digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("stored_sha1"),
        (F.unhex(F.sha2("payload", 256)) == F.col("digest")).alias("sound"),
    )
    text = F.col("header").cast("string")
    field = lambda name, value: F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1)
    parsed = headers.select(
        "digest",
        F.nullif(field("WARC-Record-ID", f"<{RECORD}(-?\\d*)>"), F.lit("")).cast("long").alias("page_id"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("recorded"),
        F.nullif(field("WARC-Refers-To", f"<{RECORD}(-?\\d*)>"), F.lit("")).cast("long").alias("refers_to"),
    )
    sound = F.col("sound") & (F.col("recorded") == F.col("stored_sha1"))
    return parsed.join(stored, "digest").select(
        "page_id",
        "payload_bytes",
        F.when(sound, F.col("recorded")).otherwise(F.raise_error(F.lit("a payload fails its digest"))).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the exact bytes of each record."""
    headers, payloads = _tables(spark, path)
    revisit = F.col("header").cast("string").contains(f"{CRLF}WARC-Type: revisit{CRLF}")
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(payloads.select("digest", "payload"), "digest").select(
        "page_id", F.concat(F.col("header"), body, F.lit(CRLF * 2).cast("binary")).alias("record")
    )
