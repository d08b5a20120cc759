"""WARC archives with revisit records, and their resolution (operator 4).

Only headers (page, digest, length) are shuffled by payload digest to find each payload's original.  Originals are written
as responses and the others as revisit records without payload, all with fresh headers, through Spark's committed text
sink: a record is a row and the record separator its line separator, so archives work on any file system Spark writes
to and a lost task leaves no half file.  Archives (gzip streams) are read back whole, record by record by Content-Length; revisits
get their payload's facts by a join with the responses on the payload digest.

Defined results: a null html is an empty payload; a null page_id ranks below every other and is written without number;
pages that repeat both page_id and payload of an original are responses too; an empty table gives an empty result;
other columns are ignored; a null url becomes urn:x-page:none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch

END = "\r\n\r\n"
LEAST_BYTES = 1000
ARCHIVE_BYTES = 32 << 20

RECORD = "page_id long, url string, record_type string, record_id string, refers_to_id string, header_digest string, payload_bytes long, payload_digest string"


def _record_id(page, digest):
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("none")), digest)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))


def resolve_originals(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(key, record_type, original): a row per distinct page_id and payload, from headers alone."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    heads = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    heads = materialize(heads, "warc-heads")
    firsts = materialize(heads.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("original")), "warc-originals")
    joined = heads.join(firsts, "digest", "left")
    revisit = F.expr(f"bytes >= {least_bytes} AND NOT page_id <=> original")
    return joined.select(_key(F.col("page_id"), F.col("digest")).alias("key"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("original"), "bytes").distinct()


def _key(page, digest):
    return F.concat(F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), digest)


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES) -> None:
    decided = materialize(resolve_originals(pages, least_bytes), "warc-types")
    total = decided.agg(F.sum(F.when(F.col("record_type") == "response", F.col("bytes")).otherwise(0) + 600)).first()[0] or 0
    files = max(1, -(-total // ARCHIVE_BYTES))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.coalesce(F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20\x7F]", "%20"), F.lit("urn:x-page:none")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    rows = rows.withColumn("key", _key(F.col("page_id"), F.col("digest"))).repartition(files, "key").join(decided.drop("bytes").repartition(files, "key"), "key")
    n = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), n, F.lit(END))
    block = F.when(F.col("record_type") == "response", F.concat(http, F.col("html"))).otherwise(http)
    refers = F.when(F.col("record_type") == "revisit", F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <"), _record_id(F.col("original"), F.col("digest")), F.lit(">\r\n"))).otherwise(F.lit(""))
    number = F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    rows = rows.withColumn("block", block)
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "record_type", F.lit("\r\nWARC-Record-ID: <"), _record_id(F.col("page_id"), F.col("digest")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), "url", F.lit("\r\n"), number, refers,
        F.lit("WARC-Payload-Digest: sha1:"), "digest", F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(END), "block",
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record."""
    if data[:2] == b"\x1f\x8b":
        data, packed = b"", data
        while packed:
            member = zlib.decompressobj(31)
            data += member.decompress(packed)
            packed = member.unused_data
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        yield head, data[end + 4 : stop]
        at = stop + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record; payload facts are those of the bytes that the record itself holds."""

    def parse(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for h, block in parse_records(data.as_py()):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    page = h.get("x-page-id")
                    rows.append((None if page is None else int(page), h["warc-target-uri"], h["warc-type"], h["warc-record-id"].strip("<>"), h.get("warc-refers-to", "").strip("<>") or None,
                                 h["warc-payload-digest"].partition(":")[2], len(payload), hashlib.sha1(payload).hexdigest()))
                    if len(rows) == 2000:
                        yield _table(rows)
                        rows = []
                yield _table(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, RECORD)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    records = materialize(records, "warc-records")
    plain = records.where("record_type = 'response'")
    originals = plain.groupBy("payload_digest").agg(F.max(F.struct("page_id", "record_id")).alias("o"), F.max("payload_bytes").alias("bytes"))
    originals = materialize(originals.select(F.col("payload_digest").alias("header_digest"), F.col("o.page_id").alias("original"), "bytes"), "warc-responses")
    revisits = records.where("record_type = 'revisit'").join(originals, "header_digest")
    return plain.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("header_digest").alias("payload_digest"), "record_type", F.col("original").alias("refers_to")))


def pages_through_archives(pages: DataFrame) -> DataFrame:
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return resolve_revisits(read_archives(pages.sparkSession, path))
