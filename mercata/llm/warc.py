"""WARC archives with revisit records for repeated payloads.

Only headers (row key, digest, length) are shuffled by payload digest to pick
each payload's original; the decision then meets the payloads once, keyed on
the row, and Spark's text writer lays the records down (a record ends in two
line breaks, which is the writer's line separator), so a lost task is written
again under Spark's commit protocol. Reading streams each archive file.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercata.session import write_table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 (160 bits: 8 groups of 20 bits, 4 characters each)."""
    digest, out = F.sha1(payload), []
    for g in range(8):
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            out.append(F.substring(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*out)


def mark_revisits(pages: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """(key, digest, record_type, refers_to) per distinct (key, digest); no payloads.

    Among records of at least ``min_bytes`` with equal payloads the one with
    the largest key is the response and the others revisit it.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    headers = write_table(pages.select(F.col(key).alias("key"), base32_sha1(body.cast("binary")).alias("digest"),
                                       F.octet_length(body).cast("long").alias("n")).distinct(), "warc-headers")
    # Partial sums leave each task with one row per digest, so a hot payload is no hot key here;
    # the join below has plain shuffles on both sides, which adaptive execution splits when skewed.
    first = write_table(headers.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("key").alias("original")),
                        "warc-originals")
    revisit = F.col("original").isNotNull() & (F.col("n") >= min_bytes) & ~F.col("key").eqNullSafe(F.col("original"))
    return headers.join(first, "digest", "left").select(
        "key", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, key: str, url: str, payload: str, min_bytes: int = 0,
                   date: str | None = None, max_records: int = 50_000) -> None:
    """Write one record per input row under ``path`` (gzip WARC/1.1 files).

    A null payload is archived as empty, a null url as an empty target. Rows
    repeated with the same key and payload are all written, all responses if
    that key is the payload's largest.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    marks = write_table(mark_revisits(pages, key, payload, min_bytes), "warc-marks")
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", " ").alias("url"),
                        body.alias("body"), base32_sha1(body.cast("binary")).alias("digest"))
    # A null-safe join cannot be split when skewed; the key's text with a marker for null can.
    name = F.coalesce(F.col("key").cast("string"), F.lit("null")).alias("name")
    rows = rows.select("*", name).join(marks.select(name, "digest", "record_type", "refers_to"), ["name", "digest"])
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("body").cast("string"), F.lit(END))
    block = F.concat(http, F.when(F.col("record_type") == "response", F.col("body")).otherwise(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("name"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("record_type") == "revisit", F.concat(
            F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("refers_to").cast("string")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    (rows.select(F.concat(head, F.lit(END), block).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path))


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a byte stream; holds one record at a time."""
    end, buffer = END.encode(), bytearray()
    done = False

    def fill() -> bool:
        nonlocal done
        piece = next(chunks, None)
        done = piece is None
        buffer.extend(piece or b"")
        return not done

    while True:
        while (at := buffer.find(end)) < 0 and fill():
            pass
        if at < 0:
            if buffer:
                raise ValueError("truncated WARC header")
            return
        lines = bytes(buffer[:at]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        stop = at + len(end) + int(head["Content-Length"])
        while len(buffer) < stop + len(end) and fill():
            pass
        if len(buffer) < stop + len(end):
            raise ValueError("truncated WARC block")
        yield head, bytes(buffer[at + len(end) : stop])
        del buffer[: stop + len(end)]


def gunzip(data: memoryview, size: int = 1 << 20) -> Iterator[bytes]:
    """Decompressed pieces of a gzip file of one or many members."""
    member = zlib.decompressobj(31)
    for a in range(0, len(data), size):
        piece = bytes(data[a : a + size])
        while piece:
            if member.eof:
                member = zlib.decompressobj(31)
            yield member.decompress(piece)
            piece = member.unused_data


READ_SCHEMA = "name string, record_type string, url string, digest string, n_bytes long, refers_name string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: name, record_type, url, digest, n_bytes, refers_name.

    A response's digest and length are computed from its payload and checked
    against the header; a revisit's come from its headers.
    """
    schema = pa.schema([("name", pa.string()), ("record_type", pa.string()), ("url", pa.string()),
                        ("digest", pa.string()), ("n_bytes", pa.int64()), ("refers_name", pa.string())])

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                for head, block in records(gunzip(memoryview(content.as_buffer()))):
                    http, _, body = block.partition(END.encode())
                    length = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (
                            len(body) != length or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise ValueError(f"damaged payload: {head['WARC-Record-ID']}")
                    name = head["WARC-Record-ID"].removeprefix("<urn:page:")[:-1]
                    refers = head.get("WARC-Refers-To")
                    out.append((name, head["WARC-Type"], head["WARC-Target-URI"], digest, length,
                                refers and refers.removeprefix("<urn:page:")[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)] if out else
                                                 [pa.array([], t.type) for t in schema], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, READ_SCHEMA)


def resolve_revisits(archived: DataFrame) -> DataFrame:
    """Join each revisit to the response it names (by digest): the input's columns, refers_name checked.

    A revisit whose response is missing keeps a null refers_name.
    """
    archived = write_table(archived, "warc-read")
    responses = write_table(archived.filter("record_type = 'response'").groupBy("digest", F.col("name").alias("found"))
                            .agg(F.count("*").alias("copies")), "warc-responses").select("digest", "found")
    revisits = archived.filter("record_type = 'revisit'").join(
        responses.withColumnRenamed("digest", "_digest"),
        (F.col("digest") == F.col("_digest")) & (F.col("refers_name") == F.col("found")), "left")
    columns = [c for c in archived.columns if c != "refers_name"]
    return (archived.filter("record_type = 'response'").select(*columns, F.lit(None).cast("string").alias("refers_name"))
            .unionByName(revisits.select(*columns, F.col("found").alias("refers_name"))))
