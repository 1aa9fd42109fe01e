"""WARC archives without repeated payloads, by revisit resolution.

1. Headers: every page's payload digest and length, taken in the JVM; no payload is shuffled for that.
2. Resolution: headers are shuffled by digest, pre-aggregated to the largest page_id of each payload. That page's record
   is the response; the others are revisits that refer to it. Payloads under ``min_bytes`` are always responses.
3. Writing: pages meet their resolved headers by page_id, which also deals them out into archives, and each becomes a
   record with fresh headers; revisits have no payload. An archive begins with a warcinfo record, and each record is
   gzipped by itself. Spark's text writer commits the files, so a lost executor leaves no half archive: a record is a
   line, and what ends a line is ``SEPARATOR``, a gzip member of nothing, which any reader of gzip passes over.
4. Reading: Spark's text reader cuts archives at the separators, in ranges of a file, so an archive is read by as many
   tasks as it has ranges and a task holds a record; it is parsed by its Content-Length.

An archive holds about ``archive_bytes`` of payload, 1 GB, or less where the session's shuffle has more tasks than that
makes. Pages that share page_id and payload, in more than one of ``SHARES`` rows and 1000, stay where they are read.

Defined results: a null html is an empty payload; a null page_id or url has no header and reads as null; rows that share
page_id and payload each have a record with an id of its own, and each of them is a response where that page_id is the
largest; revisits then name that page, but no single record. Payloads with a null page_id alone are responses. Line breaks
in a url are escaped. Only the three columns named are read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import SHARES, by_bytes, joined_by_count, written
from ferrule.plans.store import place

#: The digits of conv() to base 32, and RFC 4648's.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member of no bytes. Payloads are UTF-8, in which 1F 8B can't be, so it is in no record, compressed or stored.
SEPARATOR = bytes.fromhex("1f8b080000000000 00ff 0300 00000000 00000000").decode("latin-1")
#: How Spark's text files get and find it.
LINES = {"lineSep": SEPARATOR, "encoding": "ISO-8859-1"}
#: Pages of one key that a task can take in any case.
OFTEN = 1000


def payload_digest(payload: Column) -> Column:
    """SHA-1 in base 32: each 10 hexadecimal digits are 8 of base 32."""
    hexes = F.sha1(F.encode(payload, "UTF-8"))
    return F.translate(F.concat(*(F.lpad(F.conv(F.substring(hexes, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4))), CONV_DIGITS, BASE32_DIGITS)


def resolved(pages: DataFrame, min_bytes: int, page_id: str, html: str) -> tuple[DataFrame, int, int]:
    """A row for each page_id and payload: digest, bytes, how many pages it is, the page it refers to, or null, and whether
    that is a single record; and the bytes and number of all pages."""
    payload = F.coalesce(F.col(html), F.lit(""))
    headers = pages.select(F.col(page_id).alias("id"), payload_digest(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    headers = headers.groupBy("id", "digest", "bytes").agg(F.count("*").alias("pages"))
    headers = written(headers, "headers")  # both sides of the join below read it, and not the payloads again
    largest = headers.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.when(F.col("id").isNotNull(), F.struct("id", "pages"))).alias("largest"))
    joined = joined_by_count(headers, largest, "digest", "n")
    total, rows = headers.agg(F.sum(F.col("bytes") * F.col("pages")), F.sum("pages")).first()
    refers = F.when((F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("largest.id")), F.col("largest.id"))
    return joined.select("id", "digest", "bytes", "pages", refers.alias("refers"), (F.col("largest.pages") == 1).alias("single")), total or 0, rows or 0


def record(date: str) -> Column:
    """The text of a WARC record, from id, url, payload, digest, bytes and refers."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    name = lambda *parts: F.concat(F.lit("<urn:sha1:"), F.sha1(F.concat_ws("/", *(p.cast("string") for p in parts), "digest")), F.lit(">"))
    # of rows that agree in page_id and payload, each has the number of its own place too
    own = F.when(F.col("pages") == 1, name(F.col("id"))).otherwise(name(F.coalesce("id", F.lit(-1)), F.monotonically_increasing_id()))
    revisit = F.col("refers").isNotNull()
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", own),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri), line("X-Page-ID", F.col("id")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("bytes")),
        line("WARC-Refers-To", F.when(revisit & F.col("single"), name(F.col("refers")))), line("X-Refers-To-Page-ID", F.col("refers")),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block)), F.lit("\r\n"), block, F.lit("\r\n\r\n"),
    )


def warcinfo(date: str, part: str) -> bytes:
    """The record that an archive begins with."""
    body = b"software: ferrule\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, part)}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = 1_000_000_000, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> None:
    """Archives of all pages in the folder ``path``; ``date`` is their records', by default the time of writing."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    headers, total, n = resolved(pages, min_bytes, page_id, html)
    headers = written(headers, "resolved")
    files = -(-total // archive_bytes)
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), payload.alias("payload"), payload_digest(payload).alias("digest"))
    # one key for both sides, dealt out alike, so that payloads are shuffled once: into the archives
    key = F.concat_ws("/", F.col("id").cast("string"), "digest")
    left, right = rows.withColumn("key", key), headers.select(key.alias("key"), "bytes", "pages", "refers", "single")
    often = F.col("pages") > max(n // SHARES, OFTEN)  # fewer than SHARES keys
    hot = right.where(often)
    others, known = left.join(F.broadcast(hot.select("key")), "key", "left_anti"), right.where(~often)
    if files > int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        others, known = others.repartition(files, "key"), known.repartition(files, "key")
    joined = others.join(known.hint("merge"), "key")  # fewer archives are what the session's own shuffle makes
    joined = joined.unionByName(left.join(F.broadcast(hot), "key"))

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in by_bytes(batches, 0):
            out = [gzip.compress(r.as_buffer(), 6, mtime=0) for r in batch.column(0)]
            if first:
                out.insert(0, gzip.compress(warcinfo(date, f"{path}/{TaskContext.get().partitionId()}"), 6, mtime=0))
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # Spark's text files are of strings; the cast leaves the bytes as they are
    joined.select(record(date).alias("value")).mapInArrow(zipped, "value binary").select(F.col("value").cast("string")).write.options(**LINES).text(path)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive or a part of it, gzipped or not; no more of it is unpacked than a
    record needs, and members of nothing are passed over."""
    packed = archive[:2] == b"\x1f\x8b"
    have, at = bytearray(b"" if packed else archive), 0 if packed else len(archive)

    def more(needed: int) -> None:
        nonlocal at
        while len(have) < needed and at < len(archive):
            member = zlib.decompressobj(31)
            while not member.eof and at < len(archive):
                have.extend(member.decompress(archive[at : at + 16_384]))
                at += min(16_384, len(archive) - at)
            at -= len(member.unused_data)

    more(1)
    while have:
        while (end := have.find(b"\r\n\r\n")) < 0:
            if at == len(archive):
                raise ValueError("an archive ends within a record's headers")
            more(len(have) + 1)
        first, *lines = have[:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = dict(x.split(": ", 1) for x in lines)
        stop = end + 4 + int(headers["Content-Length"])
        more(stop + 4)
        yield headers, bytes(have[end + 4 : stop])
        del have[: stop + 4]
        more(1)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, and html (null for a
    revisit). Payloads are checked against their digests."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0):
            rows: list[tuple] = []
            for packed in batch.column(0):
                for headers, block in records(packed.as_py()):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = headers["WARC-Type"] == "response"
                    if response and b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
                    number = lambda k, headers=headers: int(headers[k]) if k in headers else None
                    rows.append((number("X-Page-ID"), headers.get("WARC-Target-URI"), headers["WARC-Type"], number("X-Refers-To-Page-ID"), number("X-Payload-Length"), digest, payload.decode("utf-8") if response else None))
            if rows:
                yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "html"])

    lines = spark.read.options(**LINES).text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(parse, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string")


def archived(pages: DataFrame, **options) -> DataFrame:
    """Pages written as archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = place(spark, "warc")
    write_archives(pages, path, **options)
    return read_archives(spark, path)
