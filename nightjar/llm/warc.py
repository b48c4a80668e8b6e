"""Operator 10, content-addressed WARC archive.

``write_archive`` lays down two Parquet tables in one folder:

* ``payloads``: every distinct payload once, under its SHA-256. While they are
  gathered, the smallest and the largest payload of each digest are compared
  byte for byte; two different payloads of one digest stop the write.
* ``headers``: one exact WARC/1.1 header block per record, with the digest of
  its payload. Of records with equal payloads of at least ``min_revisit``
  bytes, the one with the largest id is a ``response`` and the others are
  ``revisit`` records that refer to it; all others are responses.

``read_archive`` joins the two tables, parses the header blocks, checks
length and SHA-1 of each payload against its header and returns the records;
``record_bytes`` gives a record's bytes as in a WARC file.

Defined results: null html is an empty payload; a null url has no
WARC-Target-URI line; rows that share the largest id of a group are all
responses; records with a null id can be responses only of a group without
other ids; an empty table gives an empty archive. Other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

MIN_REVISIT = 1000
#: pages carry no capture time; a fixed one keeps archives reproducible.
CAPTURED = "2000-01-01T00:00:00Z"
#: Fixed value of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archive(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", min_revisit: int = MIN_REVISIT, captured: str = CAPTURED,
                  address=None) -> None:
    """Write both tables. ``address``: Column function payload -> digest
    (SHA-256 by default; tests pass a weak one to see collisions caught)."""
    address = address or (lambda c: F.sha2(c, 256))
    rows = (pick(pages, id=id_col, url=url_col, html=html_col)
            .withColumn("payload", F.coalesce(F.col("html").cast("binary"), F.lit(b""))).drop("html")
            .withColumn("address", address(F.col("payload"))))
    payloads = (rows.groupBy("address").agg(F.min("payload").alias("payload"), F.max("payload").alias("_other"))
                .withColumn("payload", F.when(F.col("payload") == F.col("_other"), F.col("payload")).otherwise(
                    F.raise_error(F.concat(F.lit("two payloads have the digest "), F.col("address")))))
                .drop("_other"))
    payloads.write.parquet(f"{folder}/payloads")
    slim = rows.select("id", "url", "address", F.octet_length("payload").cast("long").alias("n"),
                       F.sha1("payload").alias("sha1"))
    winners = (slim.where(F.col("n") >= min_revisit).groupBy("address").agg(F.max("id").alias("winner")))
    slim = slim.join(winners, "address", "left")
    revisit = (F.col("n") >= min_revisit) & ~F.col("id").eqNullSafe(F.col("winner"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:nightjar:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    block = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("winner")))).otherwise(""),
        F.when(revisit, line("WARC-Profile", F.lit(REVISIT_PROFILE))).otherwise(""),
        # a target with control characters could break the block: percent-coded
        F.coalesce(line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")),
                                                     F.lit("\n"), F.lit("%0A"))), F.lit("")),
        F.lit(f"WARC-Date: {captured}\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"))
    slim.select("address", block.cast("binary").alias("header")).write.parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, url, record_type, refers_to, payload_bytes, payload_digest,
    header, payload: every record, whole, with length and digest checked."""
    headers = spark.read.schema("address string, header binary").parquet(f"{folder}/headers")
    payloads = spark.read.schema("address string, payload binary").parquet(f"{folder}/payloads")
    text = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    page = lambda name: F.regexp_extract(field(name), r"^<urn:nightjar:page:(.*)>$", 1).try_cast("long")
    rows = (headers.join(payloads, "address")
            .withColumn("record_type", field("WARC-Type"))
            .withColumn("record_id", page("WARC-Record-ID"))
            .withColumn("refers_to", F.when(F.col("record_type") == "revisit", page("WARC-Refers-To")))
            .withColumn("url", F.when(F.contains(text, F.lit("\r\nWARC-Target-URI: ")), field("WARC-Target-URI")))
            .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
            .withColumn("payload_digest", F.sha1("payload")))
    right = ((F.concat(F.lit("sha1:"), F.col("payload_digest")) == field("WARC-Payload-Digest"))
             & (F.col("payload_bytes").cast("string") == field("X-Payload-Length")))
    return (rows.withColumn("payload_digest", F.when(right, F.col("payload_digest")).otherwise(
                F.raise_error(F.concat(F.lit("payload and header differ at "), F.col("address")))))
            .select("record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "header", "payload"))


def record_bytes():
    """Column: the bytes of a record of ``read_archive`` as in a WARC file (a
    revisit record has no block of its own)."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return F.concat(F.col("header"), body, F.lit(b"\r\n\r\n"))
