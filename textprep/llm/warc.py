"""WARC archives with revisit resolution.

Payload digests are computed in the scan, and only the headers (page id, URL, digest, length) are shuffled
by digest: the smallest page id of a digest is its original, and every other record with that digest
joins it and becomes a revisit record that carries a fresh header, the original's URI and no payload.
The archives are written by Spark's text writer (a record is header, blank line, block; records are
divided by a blank line), gzip-compressed, so a task reads each file from its start.  Reading streams
the lines of a file through a parser that takes blocks by Content-Length; memory is bounded by
one record, not by a file.

Defined cases: a null payload is empty; payloads below ``min_bytes`` are never resolved; equal ids with
equal payloads are all responses; records with a null id are responses and nobody's original, and their page id reads back as
null; a null URL stays out of the header; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textprep.llm.common import null_safe
from textprep.session import shared_dir

MIN_BYTES = 100
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"  # of records whose table has no date
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages(page_id, url, payload)`` with digest, length, refers_to and refers_uri (null for responses)."""
    rows = pages.select("page_id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload"), 256)).withColumn("length", F.octet_length("payload").cast("long"))
    heads = rows.where((F.col("length") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "url", "digest")
    first = heads.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = heads.join(first, "digest").where(F.col("page_id") > F.col("first.page_id"))
    again = again.select(
        F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_uri")
    ).distinct()
    joined = null_safe(rows, again, {"page_id": "_id", "digest": "_digest"}, "left")
    return joined.select("page_id", "url", "payload", "digest", "length", "refers_to", "refers_uri")


def _line(name: str, value) -> F.Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _urn(page_id) -> F.Column:
    digest = F.md5(F.concat(F.lit("page-"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def records(resolved: DataFrame) -> DataFrame:
    """One column ``value``: a whole WARC/1.1 record, without the blank line that divides records."""
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        _line("WARC-Page-ID", F.col("page_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Payload-Length", F.col("length")),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        _line("WARC-Refers-To-Page-ID", F.col("refers_to")),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, F.regexp_replace("refers_uri", r"[\r\n]", ""))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(block)),
    )
    return resolved.select(F.concat(header, F.lit(CRLF), block).alias("value"))


def write_archives(resolved: DataFrame, path: str) -> None:
    records(resolved).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def _parse(batches):
    """Lines (without CRLF), file by file in order, to records."""
    import pyarrow as pa

    names = ["page_id", "url", "payload", "digest", "record_type", "length", "refers_to", "block_ok"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    rows: list[tuple] = []
    header: dict[str, str] | None = None  # None between records
    block, missing, held = [], -1, 0  # missing: bytes of the block still to come, -1 in the header

    def done():
        body = b"".join(block)
        number = lambda k: int(header[k]) if k in header else None
        digest = header["warc-payload-digest"].removeprefix("sha256:")
        kind = header["warc-type"]
        ok = kind == "revisit" and not body or hashlib.sha256(body).hexdigest() == digest and len(body) == number("warc-payload-length")
        rows.append((number("warc-page-id"), header.get("warc-target-uri"), body, digest, kind, number("warc-payload-length"), number("warc-refers-to-page-id"), ok))
        return len(body)

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for lines in batches:
        for value in lines.column(0):
            raw = value.as_py() if isinstance(value, pa.BinaryScalar) else value.as_buffer().to_pybytes()
            if header is None:
                if raw == b"WARC/1.1":
                    header, block, missing = {}, [], -1
                continue
            if missing < 0:
                if raw:
                    name, _, text = raw.decode().partition(": ")
                    header[name.lower()] = text
                    continue
                missing = int(header["content-length"])
                if missing:
                    continue
            else:
                # the reader took the line's CRLF, which belongs to the block if more is to come
                raw = raw if len(raw) >= missing else raw + b"\r\n"
                block.append(raw)
                missing -= len(raw)
                if missing > 0:
                    continue
            held += done()
            header = None
            if len(rows) >= 1000 or held > 1 << 23:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives in ``path``: page_id, url, payload (binary, empty for revisits), digest,
    record_type, length, refers_to, block_ok (whether the block has the header's digest and length)."""
    lines = spark.read.option("lineSep", CRLF).text(path).select(F.col("value").cast("binary").alias("value"))
    schema = "page_id long, url string, payload binary, digest string, record_type string, length long, refers_to long, block_ok boolean"
    return lines.mapInArrow(_parse, schema)


def archive(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, payload)`` as deduplicated archives and return what is read back."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(resolve(pages, min_bytes), path)
    return read_archives(spark, path)
