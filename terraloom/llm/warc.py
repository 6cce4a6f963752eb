"""WARC archives: writing with segmentation and chunked framing, and reading back.

The writer emits one logical record per page: an HTTP response whose body has chunked transfer framing, or a revisit
where another page holds the same payload. A record whose block is over ``segment_bytes`` is split: the first segment
keeps the record's type, the others are ``continuation`` records that name the origin's id and their number; the last
gives the total length. Spark's text writer writes the bytes, so archives go to any store that Spark writes to, gzipped.

The reader parses whole archives record by record, groups segments by origin id, orders them by number, verifies
numbering and total length, and decodes the chunked framing. Repeated segments (of repeated pages) are counted first,
by origin and number, so copies never gather in one task.

Cases: a null payload is empty; a null page id becomes ``null`` in the record id and null again when read; a null url
is left out; line ends in urls are percent-coded; repeated pages give repeated records; among equal payloads, rows that
share the largest page id are all responses; a record with missing segments or a wrong length is returned with
``complete`` false and a null payload; an empty table gives no archives and no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh_path

SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
FILE_BYTES, RECORDS_PER_FILE = 64 << 20, 8192
MIN_REVISIT_BYTES = 1000

RECORD = "record_id string, type string, target string, refers_to string, payload binary, payload_bytes long, payload_digest string, complete boolean"
_SEGMENT = "origin string, number int, total long, type string, target string, digest string, block binary"


def _text(value: Column) -> Column:
    """Bytes as a string column, unchanged."""
    return value.cast("string")


def plan_revisits(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """key, url, payload (binary), digest, size, first: the response's key for revisits, else null."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    large = rows.where(F.col("size") >= least).select("key", "digest", "size")
    shared = large.groupBy("digest", "size").agg(F.max("key").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "size", "top")
    # payloads never meet by digest, where equal ones would gather in one task, but by page; a merge join of the ids, for adaptive execution splits its hot keys
    again = large.join(shared.hint("merge"), ["digest", "size"]).where(~F.col("top").eqNullSafe(F.col("key")))
    spread = F.xxhash64("key", "digest")
    again = again.select(spread.alias("spread"), F.col("key").alias("_key"), F.col("digest").alias("_digest"), F.col("top").alias("first")).distinct()
    same = (spread == F.col("spread")) & F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest"))
    return rows.join(again, same, "left").select("key", "url", "payload", "digest", "size", "first")


def write_archives(pages: DataFrame, path: str, *, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, **columns: str) -> None:
    """Write one logical record per page under ``path``."""
    rows = plan_revisits(pages, **columns)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record_id = lambda key: F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(">"))
    revisit = F.col("first").isNotNull()
    size = F.greatest(F.lit(chunk_bytes), F.ceil(F.col("size") / 4096).cast("int"))
    chunks = F.transform(
        F.when(F.col("size") > 0, F.sequence(F.lit(0), F.ceil(F.col("size") / size).cast("int") - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.concat(F.lower(F.hex(F.least(size.cast("long"), F.col("size") - k * size))), F.lit("\r\n"), _text(F.substring(F.col("payload"), k * size + 1, size)), F.lit("\r\n")),
    )
    http = F.when(revisit, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))).otherwise(
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"), F.array_join(chunks, ""), F.lit("0\r\n\r\n"))
    )
    rows = rows.select("key", "url", "digest", "first", http.cast("binary").alias("block")).withColumn("length", F.octet_length("block"))
    count = F.greatest(F.lit(1), F.ceil(F.col("length") / segment_bytes).cast("int"))
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(1), count)))
    part = F.substring(F.col("block"), (F.col("number") - 1) * segment_bytes + 1, F.lit(segment_bytes))
    own = record_id(F.col("key"))
    later, split = F.col("number") > 1, F.col("length") > segment_bytes
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(later, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(later, F.concat(F.rtrim(own, F.lit(">")), F.lit(":"), F.col("number").cast("string"), F.lit(">"))).otherwise(own)),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit & ~later, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(F.col("first"))))).otherwise(F.lit("")),
        F.when(split, line("WARC-Segment-Number", F.col("number").cast("string"))).otherwise(F.lit("")),
        F.when(later, line("WARC-Segment-Origin-ID", own)).otherwise(F.lit("")),
        F.when(later & (F.col("number") * segment_bytes >= F.col("length")), line("WARC-Segment-Total-Length", F.col("length").cast("string"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(part).cast("string")),
        F.lit("\r\n"),
    )
    each = pages.agg(F.avg(F.octet_length(columns.get("payload", "html")))).first()[0] or 0.0
    most = max(1, min(RECORDS_PER_FILE, int(FILE_BYTES / min(max(each, 1.0), segment_bytes))))  # archives are read whole
    # the text writer adds the last line feed of the record's end
    rows.select(F.concat(header, _text(part), F.lit("\r\n\r")).alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


class _Bytes:
    """A gzipped (one member or many) or plain archive, read as a stream."""

    def __init__(self, content: bytes | memoryview):
        self.rest, self.buffer, self.at = memoryview(content), b"", 0
        self.zipped = bytes(self.rest[:2]) == b"\x1f\x8b"
        self.unzip = zlib.decompressobj(31)

    def _more(self) -> bool:
        if not len(self.rest):
            return False
        piece, self.rest = self.rest[: 1 << 20], self.rest[1 << 20 :]
        data = bytes(piece)
        if self.zipped:
            data = self.unzip.decompress(piece)
            while self.unzip.eof and self.unzip.unused_data:
                left = self.unzip.unused_data
                self.unzip = zlib.decompressobj(31)
                data += self.unzip.decompress(left)
            if self.unzip.eof and len(self.rest):
                self.unzip = zlib.decompressobj(31)
        self.buffer, self.at = self.buffer[self.at :] + data, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (end := self.buffer.find(mark, self.at)) < 0:
            if not self._more():
                return None
        out, self.at = self.buffer[self.at : end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while True:
            piece = self.buffer[self.at : self.at + n - have]
            parts.append(piece)
            have += len(piece)
            self.at += len(piece)
            if have == n or not self._more():
                return b"".join(parts)


def parse_archive(content: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record."""
    stream = _Bytes(content)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(headers["content-length"]))
        yield headers, block
        stream.take(4)


def dechunked(body: bytes) -> bytes:
    """Decode chunked transfer framing; extensions and trailers are dropped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + n]
        if len(piece) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(piece)
        at = end + 4 + n


def _payload(block: bytes) -> tuple[bytes, int | None]:
    """The decoded body of an HTTP message and its Content-Length."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = head.decode("latin-1").lower()
    length = re.search(r"\ncontent-length:\s*(\d+)", headers)
    return dechunked(body) if re.search(r"\ntransfer-encoding:\s*chunked", headers) else body, int(length[1]) if length else None


def _row(headers: dict[str, str], block: bytes) -> tuple:
    name, digest = headers["warc-type"], headers.get("warc-payload-digest", "").rpartition(":")[2] or None
    try:
        body, length = _payload(block) if headers.get("content-type", "").startswith("application/http") else (block, len(block))
    except ValueError:
        return headers.get("warc-record-id"), name, headers.get("warc-target-uri"), headers.get("warc-refers-to"), None, None, digest, False
    if name == "revisit":
        return headers.get("warc-record-id"), name, headers.get("warc-target-uri"), headers.get("warc-refers-to"), None, length, digest, True
    found = hashlib.sha1(body).hexdigest()
    return headers.get("warc-record-id"), name, headers.get("warc-target-uri"), headers.get("warc-refers-to"), body, len(body), found, digest in (None, found)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    part, held = [], 0
    for r in rows:
        part.append(r)
        held += 200 + sum(len(x) for x in r if isinstance(x, bytes))
        if held > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every logical record under ``path``: record_id, type, target, refers_to, payload, payload_bytes, payload_digest, complete."""
    record, segment = _arrow(RECORD), _arrow(_SEGMENT)
    files = spark.read.format("binaryFile").load(path).select("content")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
        for batch in batches:
            for value in batch.column(0):
                yield from parse_archive(memoryview(value.as_buffer()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((_row(h, b) for h, b in contents(batches) if "warc-segment-number" not in h), record)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((h.get("warc-segment-origin-id", h.get("warc-record-id")), int(h["warc-segment-number"]), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, None if h["warc-type"] == "continuation" else h["warc-type"], h.get("warc-target-uri"), h.get("warc-payload-digest"), b) for h, b in contents(batches) if "warc-segment-number" in h), segment)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row in batch.to_pylist():
                    parts = row["parts"]
                    block = b"".join(p["block"] for p in parts)
                    headers = {"warc-record-id": row["origin"], "warc-type": row["type"] or "continuation", "content-type": "application/http"} | {k: v for k, v in (("warc-target-uri", row["target"]), ("warc-payload-digest", row["digest"])) if v}
                    good = [p["number"] for p in parts] == [*range(1, len(parts) + 1)] and row["total"] == len(block) and row["type"] is not None
                    out = _row(headers, block) if good else (row["origin"], headers["warc-type"], row["target"], None, None, None, None, False)
                    yield from [out] * row["copies"]

        yield from _batches(rows(), record)

    once = files.mapInArrow(segments, _SEGMENT).groupBy("origin", "number").agg(F.max("total").alias("total"), F.max("type").alias("type"), F.max("target").alias("target"), F.max("digest").alias("digest"), F.first("block").alias("block"), F.count("*").alias("copies"))
    grouped = once.groupBy("origin").agg(F.max("total").alias("total"), F.max("type").alias("type"), F.max("target").alias("target"), F.max("digest").alias("digest"), F.max("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"))
    return files.mapInArrow(whole, RECORD).unionByName(grouped.mapInArrow(joined, RECORD))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    key = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[^:]*):", 1)
    as_key = lambda c: F.when(key(c).isin("", "null"), F.lit(None)).otherwise(key(c)).cast(kind)
    bad = F.when(~F.col("complete"), F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))).cast("string"))
    return read_archives(spark, path).select(as_key(F.col("record_id")).alias("page_id"), "payload_bytes", F.coalesce(bad, F.col("payload_digest")).alias("payload_digest"), F.col("type").alias("record_type"), as_key(F.col("refers_to")).alias("refers_to"))
