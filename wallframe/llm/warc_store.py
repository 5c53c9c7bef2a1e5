"""Content-addressed WARC archive.

A record is its exact header bytes and a payload.  Payload bytes are stored once per SHA-256 and
length; headers are a table of their own that names the payload.  Reading joins the two, checks
length and digest again and gives back the records byte for byte.  All work is column expressions.

Of records with equal payloads of at least ``least`` bytes the one with the largest id is the
response, the others are revisits of it; shorter payloads are responses each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import shared_dir
from .common import text_bytes

LEAST = 1000
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(row: Column) -> Column:
    """A name-based identifier from the record's number and url."""
    digest = F.md5(F.concat_ws("|", F.lit("record"), F.coalesce(row.cast("string"), F.lit("null"))).cast("binary"))
    part = lambda at, size: F.substring(digest, at, size)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line; control characters of the value are percent-encoded, null gives no line."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(END)), F.lit(""))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", *, least: int = LEAST, date: str = DATE) -> DataFrame:
    """page_id, record_type, refers_to, header, payload, n_bytes, digest, sha1 of every page.

    Null html is an empty payload, a null url leaves its header line out.  Of rows that repeat the
    largest id of a payload, each is a response.
    """
    payload = text_bytes(html)
    read = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
        F.length(payload).cast("bigint").alias("n_bytes"), F.sha2(payload, 256).alias("digest"), F.sha1(payload).alias("sha1"),
    )
    # Only digests and ids are grouped; payload bytes do not move here.
    first = read.filter(F.col("n_bytes") >= least).groupBy("digest", "n_bytes").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("many"))
    met = read.join(first.filter("many > 1"), ["digest", "n_bytes"], "left")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(again, F.col("original"))
    named = met.select("page_id", "url", "payload", "n_bytes", "digest", "sha1", kind.alias("record_type"), refers.alias("refers_to"))
    block = F.when(F.col("record_type") == "response", F.col("n_bytes")).otherwise(F.lit(0)) + len(HTTP)
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", _uuid(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("X-Page-ID", F.col("page_id").cast("string")),
        _field("X-Payload-Length", F.col("n_bytes").cast("string")),
        _field("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(REVISIT))),
        _field("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), _uuid(F.col("refers_to")))),
        _field("X-Refers-To-Page", F.col("refers_to").cast("string")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", block.cast("string")),
        F.lit(f"{END}{HTTP}"),
    )
    return named.select("page_id", "record_type", "refers_to", header.cast("binary").alias("header"), "payload", "n_bytes", "digest", "sha1")


class Archive:
    """Two tables in one folder: ``headers`` (row, page_id, header, digest, n_bytes) and ``payloads`` (digest, n_bytes, payload)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/wallframe/warc-{uuid.uuid4().hex}"

    def write(self, made: DataFrame) -> Archive:
        """Store records; a payload is written once for its digest and length."""
        made.select("page_id", "header", "digest", "n_bytes").write.parquet(f"{self.path}/headers")
        made.select("digest", "n_bytes", "payload").dropDuplicates(["digest", "n_bytes"]).write.parquet(f"{self.path}/payloads")
        return self

    def read(self) -> DataFrame:
        """page_id, header, payload: the records again; a payload that is missing or altered is an error."""
        headers = self.spark.read.parquet(f"{self.path}/headers")
        payloads = self.spark.read.parquet(f"{self.path}/payloads")
        met = headers.join(payloads.withColumn("found", F.lit(True)), ["digest", "n_bytes"], "left")
        sound = F.col("found") & (F.sha2("payload", 256) == F.col("digest")) & (F.length("payload") == F.col("n_bytes"))
        checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload lost or altered: "), F.col("digest"))).cast("binary"))
        return met.select("page_id", "header", checked.alias("payload"))


def record_bytes(header: str = "header", payload: str = "payload") -> Column:
    """The bytes of a whole record; a revisit has no payload of its own."""
    revisit = F.col(header).cast("string").contains("\r\nWARC-Type: revisit\r\n")
    return F.concat(F.col(header), F.when(revisit, F.lit("").cast("binary")).otherwise(F.col(payload)), F.lit("\r\n\r\n").cast("binary"))


def parsed(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from headers and payloads read back."""
    text = F.col("header").cast("string")
    line = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    return read.select(
        "page_id",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        line("WARC-Type").alias("record_type"),
        line("X-Refers-To-Page").cast("bigint").alias("refers_to"),
    )


def export_warc(read: DataFrame, path: str) -> None:
    """Write records as WARC files, one per task; the text writer ends each record with its two empty lines."""
    whole = F.concat(F.col("header"), F.when(F.col("header").cast("string").contains("\r\nWARC-Type: revisit\r\n"), F.lit("").cast("binary")).otherwise(F.col("payload")))
    read.select(whole.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """header, payload of every record of WARC files, cut by Content-Length."""

    def cut(batches):
        import re

        import pandas as pd

        for batch in batches:
            for data in batch["content"]:
                at, out = 0, []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", data[at:end])[1])
                    inner = data.index(b"\r\n\r\n", end) + 4
                    out.append((data[at:inner], data[inner : end + size]))
                    at = end + size + 4
                yield pd.DataFrame(out, columns=["header", "payload"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInPandas(cut, "header binary, payload binary")


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", *, least: int = LEAST) -> Archive:
    """Write the records of ``pages`` to a new archive in the shared folder."""
    return Archive(pages.sparkSession).write(records(pages, page_id, url, html, least=least))
