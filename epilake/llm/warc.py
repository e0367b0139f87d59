"""WARC archives with revisit records, written and read by Spark's own sinks and sources.

Write: headers (page_id, SHA-1 payload digest) are aggregated by digest to the
one response of each payload; pages look their digest up in the table of digests
that occur more than once, and become a `response` record or a `revisit` (profile
identical-payload-digest) without payload. Record text goes through the text
sink, with the blank lines that end a record as line separator, so a file is a
WARC file (gzip); the commit protocol keeps files whole when executors are lost.

Read: each archive is one row of the binary source; the parser walks records by
Content-Length, so payloads may hold any bytes. A response's digest and length
are computed from its payload; a revisit carries the payload digest and, in its
HTTP header block, the payload length. `resolve` joins revisits to the payloads
of their responses.

Edge cases: null html is an empty payload. Equal payloads below `min_bytes` are
all responses. Rows with the same page_id and payload, if that is the largest
id, are all written as responses. A null page_id is smaller than any other and
is written as an empty id. Line breaks and spaces in a url are percent-encoded.
An empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilake.llm import text as T
from epilake.llm.tables import fresh_path, lookup, read_table

DATE = "2024-01-01T00:00:00Z"
#: Records in a file, so that an archive stays within a task's memory.
FILE_RECORDS = 5_000
_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four groups of 40 bits, each 8 digits of base 32."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def with_headers(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"),
                        base32_sha1(F.encode(html, "UTF-8")).alias("payload_digest"))


def revisit_table(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """payload_digest, response_id, n of the payloads that occur more than once (partial sums before the shuffle)."""
    seen = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
    return seen.agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


def decide(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """record_type and refers_to of every row."""
    light = headers.select("page_id", "payload_bytes", "payload_digest")
    got = lookup(headers, revisit_table(light, min_bytes), "payload_digest", "warc-revisits", weight="n")
    again = (F.col("payload_bytes") >= min_bytes) & F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return got.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(again, F.col("response_id")))


def _safe_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), " ", "%20")


def record_text(rows: DataFrame) -> DataFrame:
    """One column `value`: the record without the two line ends that follow it."""
    end = F.lit("\r\n")
    record_id = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    url = _safe_url(F.col("url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("record_type") == "revisit"
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), end, F.lit("WARC-Record-ID: "), record_id, end,
        F.lit(f"WARC-Date: {DATE}\r\nWARC-Target-URI: "), url, end,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), end,
        F.when(revisit, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:x-page:"),
            F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(f">\r\nWARC-Refers-To-Date: {DATE}\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))
    return rows.select(F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_records: int = FILE_RECORDS) -> None:
    """Deduplicated archives below `path`, each with at most `file_records` records."""
    rows = record_text(decide(with_headers(pages), min_bytes))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named header fields and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block = data[end + 4:end + 4 + size]
        if lines[0] != "WARC/1.1" or len(block) != size or data[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"broken record at byte {at}")
        yield fields, block
        at = end + 8 + size


def _id(uri: str) -> int | None:
    text = uri.removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


RECORD_SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
                 "payload_digest string, payload binary")


def _read_partition(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for fields, block in _records(zlib.decompress(content.as_py(), 31)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        if digest != said:
                            raise ValueError(f"payload digest of {fields['WARC-Record-ID']} is {digest}, not {said}")
                    else:
                        digest, n = said, int(http.rpartition(b"Content-Length: ")[2])
                    refers = _id(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((_id(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, refers, n, digest,
                                 payload if payloads and kind == "response" else None))
                    size += len(payload)
                    if size > T.GROUP:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record; a response's digest is checked against its payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read_partition(payloads), RECORD_SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """Every record with its payload: revisits get that of the response of the same digest."""
    original = (records.where("record_type = 'response'").groupBy("payload_digest")
                .agg(F.max_by("payload", "page_id").alias("_payload")))
    got = records.join(original, "payload_digest", "left")
    return got.withColumn("payload", F.coalesce("payload", "_payload")).drop("_payload")


def op3_warc_revisits(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    got = read_archives(spark, path, payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: SHA-1 has no DuckDB function of base32; four groups of 40 bits are spelled digit by digit.
OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         coalesce(url, '') AS url
  FROM pages),
h AS (SELECT page_id, url, payload_bytes, sha1(html) AS hex FROM p),
g AS (
  SELECT page_id, url, payload_bytes, hex,
         list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(hex, (1 + 10 * (i // 8))::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31))::BIGINT, 1)) AS digits
  FROM h),
m AS (SELECT hex, max(page_id) AS last FROM g GROUP BY hex)
SELECT page_id, payload_bytes, array_to_string(digits, '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to,
       replace(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), ' ', '%20') AS url
FROM g JOIN m USING (hex)
"""
