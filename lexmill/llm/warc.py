"""WARC archives of web pages, written and read as chunked records.

A payload is never handled as one piece beyond its own table cell: it is cut into rows of
``(record, chunk number, bytes)``, and digests are carried from chunk to chunk.  Payloads of more
than ``CHUNK_BYTES`` become segmented records (a first record and ``continuation`` records).  The
archives are written by Spark's text writer, one gzip file per task, each holding whole records, and
read by its text reader line by line, so neither side holds more than a chunk.

Of records with equal payloads of at least ``LEAST_SHARED`` bytes the one with the largest key is a
``response``, the others are ``revisit`` records that name it.

Defined results: a null payload is empty; null addresses are written as empty; rows with equal keys
and payloads are written each; a null key is written as ``-`` and read back as null; a group whose keys
are all null consists of responses; payloads may hold anything, also text that looks like a record; an
empty table gives an archive without records; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.session import new_folder, stored

CHUNK_BYTES = 256 * 1024
LEAST_SHARED = 1000

# The record format.
LINE_END = "\r\n"
VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"

DIGESTS = "page_id long, payload_bytes long, payload_digest string"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, intact boolean"
)


def chunks(payload: Column, size: int = CHUNK_BYTES) -> Column:
    """Array of ``(chunk, last, data)`` of a binary payload; an empty one has one empty chunk."""
    length = F.octet_length(payload)
    count = F.greatest(F.lit(1), F.ceil(length / size).cast("int"))
    return F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.struct(
            i.alias("chunk"),
            (i == count).alias("last"),
            F.substring(payload, (i - 1) * size + 1, F.lit(size)).alias("data"),
        ),
    )


def _payload(html: str) -> Column:
    return F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")


def _digest_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and length of each record from its chunks, which follow one another."""
    digest, total = hashlib.sha1(), 0
    for batch in batches:
        out: list[tuple] = []
        keys = batch["page_id"].to_pylist()
        for key, last, data in zip(keys, batch["last"].to_pylist(), batch["data"].to_pylist()):
            digest.update(data)
            total += len(data)
            if last:
                out.append((key, total, digest.hexdigest()))
                digest, total = hashlib.sha1(), 0
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
             pa.array(columns[2], pa.string())],
            ["page_id", "payload_bytes", "payload_digest"],
        )


def payload_digests(
    pages: DataFrame, key: str = "page_id", html: str = "html", size: int = CHUNK_BYTES
) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest)`` of every row, without a shuffle."""
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.inline(chunks(_payload(html), size))
    )
    return rows.drop("chunk").mapInArrow(_digest_chunks, DIGESTS)


def record_types(digests: DataFrame) -> DataFrame:
    """Adds ``refers_to`` (null for a response); one row per key and payload."""
    spark = digests.sparkSession
    digests = stored(digests, new_folder(spark, "payload-digests"))
    large = F.col("payload_bytes") >= LEAST_SHARED
    first = (
        digests.where(large)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    # Written, so that the join has plain sides and a payload of many rows can be split.
    first = stored(first, new_folder(spark, "shared-payloads"))
    joined = digests.join(first, ["payload_digest", "payload_bytes"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("page_id", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def _fields(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a field with a null value is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in pairs]
    return F.concat_ws(LINE_END, F.lit(VERSION), *lines)


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
    size: int = CHUNK_BYTES,
) -> None:
    """Writes a record per row of ``pages`` into gzip archives in ``folder``."""
    spark = pages.sparkSession
    types = record_types(payload_digests(pages, key, html, size)).distinct()
    types = stored(types, new_folder(spark, "record-types"))
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "%0A").alias("url"),
        _payload(html).alias("payload"),
    )
    same = F.col("p.page_id").eqNullSafe(F.col("t.page_id")) & (
        F.sha1("p.payload") == F.col("t.payload_digest")
    )
    joined = rows.alias("p").join(types.alias("t"), same).select("p.*", *(
        F.col(f"t.{name}") for name in ("payload_bytes", "payload_digest", "refers_to")
    ))
    revisit = F.col("refers_to").isNotNull()
    parts = joined.withColumn("payload", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    # Chunks of a row follow one another in the task that made them.
    parts = parts.select(
        *(c for c in parts.columns if c != "payload"), F.inline(chunks(F.col("payload"), size))
    )
    first = F.col("chunk") == 1
    segmented = ~(first & F.col("last"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    urn = F.concat(F.lit(f"<{RECORD_URN}"), name, F.lit(">"))
    chunk_urn = F.concat(F.lit(f"<{RECORD_URN}"), name, F.lit(":"), F.col("chunk"), F.lit(">"))
    kind = F.when(revisit, "revisit").when(first, "response").otherwise("continuation")
    head = F.when(first & ~revisit, F.lit(HTTP_HEAD)).otherwise(F.lit(""))
    header = _fields(
        ("WARC-Type", kind),
        ("WARC-Record-ID", F.when(first, urn).otherwise(chunk_urn)),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Payload-Length", F.when(first, F.col("payload_bytes"))),
        ("WARC-Refers-To", F.concat(F.lit(f"<{RECORD_URN}"), F.col("refers_to"), F.lit(">"))),
        ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        ("WARC-Segment-Number", F.when(segmented, F.col("chunk"))),
        ("WARC-Segment-Origin-ID", F.when(~first, urn)),
        (
            "WARC-Segment-Total-Length",
            F.when(segmented & F.col("last"), F.col("payload_bytes") + len(HTTP_HEAD)),
        ),
        ("Content-Type", F.when(first & ~revisit, F.lit("application/http; msgtype=response"))),
        ("Content-Length", F.octet_length(head) + F.octet_length("data")),
    )
    end = F.lit(LINE_END.encode())
    value = F.concat(
        F.encode(F.concat(header, F.lit(LINE_END * 2), head), "UTF-8"), F.col("data"), end
    )
    # The writer ends each row with the second line end that closes a record.
    parts.select(value.cast("string").alias("value")).write.option("lineSep", LINE_END).option(
        "compression", "gzip"
    ).text(folder)


class _Reader:
    """Records from the lines of an archive; holds one line and the digest so far."""

    def __init__(self) -> None:
        self.header: list[bytes] = []
        self.fields: dict[str, str] = {}
        self.body = self.rest = 0
        self.in_body = self.in_http = False
        self.record: dict[str, str] = {}
        self.digest, self.total = hashlib.sha1(), 0

    def line(self, line: bytes) -> tuple | None:
        """Takes the next line and returns a record that it completes."""
        if not self.in_body:
            if line:
                self.header.append(line)
            elif self.header:
                self._open()
            return None
        data = line + b"\r\n"
        block = data[: self.body]
        if self.in_http:
            self.in_http = line != b""
        elif self.record.get("WARC-Type") == "response":
            self.digest.update(block)
            self.total += len(block)
        self.body -= len(block)
        self.rest -= len(data)
        return None if self.rest else self._close()

    def _open(self) -> None:
        if self.header[0] != VERSION.encode():
            raise ValueError(f"not the start of a record: {self.header[0][:60]!r}")
        pairs = (field.decode("utf-8", "replace").partition(": ") for field in self.header[1:])
        self.fields = {name: value for name, _, value in pairs}
        self.header = []
        self.body = int(self.fields["Content-Length"])
        self.rest = self.body + 4
        self.in_body = True
        if self.fields["WARC-Type"] != "continuation":
            self.record = self.fields
            self.digest, self.total = hashlib.sha1(), 0
            self.in_http = self.fields["WARC-Type"] == "response"

    def _close(self) -> tuple | None:
        self.in_body = False
        more = "WARC-Segment-Number" in self.fields
        if more and "WARC-Segment-Total-Length" not in self.fields:
            return None
        record = self.record
        stated = record["WARC-Payload-Digest"].removeprefix("sha1:")
        length = int(record["WARC-Payload-Length"])
        key = record["WARC-Record-ID"][1 + len(RECORD_URN) : -1]
        refers = record.get("WARC-Refers-To")
        revisit = refers is not None
        return (
            None if key == "-" else int(key),
            record["WARC-Target-URI"],
            length if revisit else self.total,
            stated if revisit else self.digest.hexdigest(),
            record["WARC-Type"],
            int(refers[1 + len(RECORD_URN) : -1]) if revisit else None,
            revisit or (self.total, self.digest.hexdigest()) == (length, stated),
        )


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    names = [part.split()[0] for part in RECORDS.split(", ")]
    for batch in batches:
        found = [r for line in batch["value"].to_pylist() if (r := reader.line(line)) is not None]
        columns = list(zip(*found)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds)], names
        )
    if reader.in_body or reader.header:
        raise ValueError("an archive ends inside a record")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives in ``folder``.

    Length and digest of a response are those of the payload as read; ``intact`` tells whether they
    agree with its header.  A gzip file is read from its start by one task, so records stay whole.
    """
    lines = spark.read.option("lineSep", LINE_END).text(folder)
    return lines.select(F.col("value").cast("binary")).mapInArrow(_read_lines, RECORDS)


def roundtrip(pages: DataFrame) -> DataFrame:
    """Writes archives of ``pages``, reads them back and reports each record."""
    folder = new_folder(pages.sparkSession, "archives")
    write_archives(pages, folder)
    found = read_archives(pages.sparkSession, folder)
    # A damaged record fails the query instead of passing for a page.
    sound = F.assert_true(F.col("intact"), F.lit("payload differs from its header"))
    return found.where(sound.isNull()).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
