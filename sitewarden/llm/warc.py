"""WARC archives: writing segmented records with chunked bodies, and reading them back whole.

Writing is DataFrame work only. A payload becomes an HTTP response in chunked transfer framing; a message longer than
`segment_chars` characters is cut into a first record and continuation records that name the first as their origin. Of
records with equal payloads of at least `least_bytes` bytes, the one with the largest key keeps the payload, the others
are revisits of it. Files are gzip-compressed text of at most `records_per_file` records.

Reading takes whole files as rows, walks their records by Content-Length, groups the segments of a record by origin,
orders them by number, checks that they are complete and as long as the last one says, and decodes the chunked framing.

Null payload counts as empty. Rows without a key are responses of their own. Repeated rows are separate records; when
they hold the largest key of their payload, all of them are responses. Records that are broken (a missing segment, a
wrong total length, bad framing) come back with `intact` false and no payload. Where a file cannot be read on (a header
without end or length, a block that is cut off, a damaged or unfinished gzip member), its records before that place are
kept, and the rest is one broken record, with the header fields that could be read. A broken segment is such a record
besides the one it belongs to; segments without their first record are a broken record under the identifier of that
record. Empty tables and empty files give no records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST_BYTES = 1000
SEGMENT_CHARS, CHUNK_CHARS = 32_768, 8_192
RECORDS_PER_FILE = 1_000
CRLF, GZIP = "\r\n", b"\x1f\x8b"
#: Bytes that are given to the decompressor at a time.
SLICE = 1 << 16
#: The capture time is not in the table; the format asks for one.
DATE = "1970-01-01T00:00:00Z"

RECORD = "kind string, record_id string, key bigint, uri string, refers_to string, digest string, segment int, origin string, total bigint, block binary, sound boolean"
HEAD = ["kind", "record_id", "key", "uri", "refers_to", "digest"]
WHOLE = "kind string, record_id string, key bigint, uri string, refers_to string, digest string, intact boolean, payload binary, payload_bytes bigint, payload_digest string"


def _record_id(key: Column, digest: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("none")), digest, copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *[p for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for p in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def _chunked(body: Column, size: int) -> Column:
    """Chunked transfer framing; a chunk's length counts bytes."""
    count = F.ceil(F.length(body) / size).cast("int")

    def chunk(i: Column) -> Column:
        part = F.substring(body, i * size + 1, F.lit(size))
        return F.concat(F.lower(F.hex(F.octet_length(part))), F.lit(CRLF), part, F.lit(CRLF))

    chunks = F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(0), count - 1), chunk), "")).otherwise("")
    return F.concat(chunks, F.lit("0" + CRLF + CRLF))


def _headers(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(name + ": "), value.cast("string"), F.lit(CRLF)), F.lit("")) for name, value in pairs])


def records(pages: DataFrame, key: str, uri: str, payload: str, least_bytes: int = LEAST_BYTES, segment_chars: int = SEGMENT_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The text of each record, without the blank lines that end it."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.regexp_replace(uri, r"[\r\n]", " ").alias("uri"), body.alias("body"), F.sha1(body).alias("digest"))
    large = rows.where(F.octet_length("body") >= least_bytes).select("key", "digest")
    keepers = large.groupBy("digest").agg(F.max("key").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = large.join(keepers, "digest").where("key < keeper").distinct()
    rows = rows.join(repeats, ["key", "digest"], "left")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("key", "digest").orderBy("uri")))
    first = F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Transfer-Encoding: chunked" + CRLF + CRLF)
    again = F.col("keeper").isNotNull()
    rows = rows.select(
        "key", "uri", "digest", again.alias("again"), _record_id(F.col("key"), F.col("digest"), F.col("copy")).alias("id"),
        F.when(again, _record_id(F.col("keeper"), F.col("digest"), F.lit(1))).alias("refers_to"),
        F.when(again, first).otherwise(F.concat(first, _chunked(F.col("body"), chunk_chars))).alias("message"),
    )
    count = F.ceil(F.length("message") / segment_chars).cast("int")
    rows = rows.withColumn("segments", count).withColumn("at", F.explode(F.sequence(F.lit(1), count)))
    block = F.substring("message", (F.col("at") - 1) * segment_chars + 1, F.lit(segment_chars))
    rows = rows.withColumn("block", block)
    cut, later = F.col("segments") > 1, F.col("at") > 1
    return rows.select(F.concat(
        F.lit("WARC/1.1" + CRLF),
        _headers(
            ("WARC-Type", F.when(later, "continuation").when(F.col("again"), "revisit").otherwise("response")),
            ("WARC-Record-ID", F.when(later, _record_id(F.col("key"), F.col("id"), F.col("at"))).otherwise(F.col("id"))),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", F.col("uri")),
            ("WARC-Payload-Digest", F.when(~later, F.concat(F.lit("sha1:"), F.col("digest")))),
            ("WARC-Refers-To", F.col("refers_to")),
            ("WARC-Profile", F.when(F.col("again"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("Source-Key", F.col("key")),
            ("WARC-Segment-Number", F.when(cut, F.col("at"))),
            ("WARC-Segment-Origin-ID", F.when(later, F.col("id"))),
            ("WARC-Segment-Total-Length", F.when(cut & (F.col("at") == F.col("segments")), F.octet_length("message"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length("block")),
        ),
        F.lit(CRLF), F.col("block"),
    ).alias("value"))


def write(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", records_per_file: int = RECORDS_PER_FILE, **options) -> None:
    out = records(pages, key, uri, payload, **options).write.option("maxRecordsPerFile", records_per_file)
    out.option("compression", "gzip").option("lineSep", CRLF + CRLF).text(folder)


def inflated(data: bytes) -> tuple[bytes, bool]:
    """The content of a file of any number of gzip members, and whether all of it could be read."""
    if data[:2] != GZIP:
        return data, True
    parts, at = [], 0
    while data[at : at + 2] == GZIP:
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                return b"".join(parts), False
            piece = data[at : at + SLICE]
            try:
                parts.append(member.decompress(piece))
            except zlib.error:
                return b"".join(parts), False
            at += len(piece) - len(member.unused_data)
    return b"".join(parts), not data[at:].strip(b"\0")


def number(value: str | None, digits: int = 18) -> int | None:
    """A header field as a number, None where it is not one."""
    return int(value) if value and re.fullmatch(rf"-?[0-9]{{1,{digits}}}", value) else None


def walk(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Headers (names in lower case) and block of each record, and whether it is whole; one that is not is the last."""
    (data, sound), at = inflated(data), 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        lines = data[start : end if end >= 0 else len(data)].decode("utf-8", "replace").split(CRLF)[1:]
        headers = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines)}
        length = number(headers.get("content-length")) if end >= 0 else None
        if length is None or length < 0 or end + 4 + length > len(data):
            yield headers, data[start:], False
            return
        at = end + 4 + length
        yield headers, data[end + 4 : at], True
    if not sound or data[at:].strip():
        yield {}, data[at:], False


def parse(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
    for batch in files:
        for content in batch.column(0):
            rows = []
            for h, block, sound in walk(content.as_py()):
                digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                rows.append((
                    h.get("warc-type"), h.get("warc-record-id"), number(h.get("source-key")), h.get("warc-target-uri"), h.get("warc-refers-to"), digest,
                    number(h.get("warc-segment-number"), 9), h.get("warc-segment-origin-id"), number(h.get("warc-segment-total-length")),
                    block if sound else None, sound and ("warc-segment-number" not in h or "warc-segment-origin-id" in h or "warc-record-id" in h),
                ))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)


def dechunk(body: bytes) -> bytes | None:
    """The data of a chunked body; None if the framing is broken or unfinished."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or body[end + 2 + size : end + 4 + size] != b"\r\n" and size:
            return None
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def payload_of(message: bytes | None) -> bytes | None:
    """The body of an HTTP message."""
    if message is None or (end := message.find(b"\r\n\r\n")) < 0:
        return None
    head, body = message[:end].lower(), message[end + 4 :]
    return dechunk(body) if b"transfer-encoding: chunked" in head else body


def message_of(segments: list[dict]) -> bytes | None:
    """The joined blocks if all numbers from 1 on are there and the total is as announced; repeated segments count once."""
    by_number = {s["segment"]: s for s in segments}
    whole = b"".join(by_number[n]["block"] for n in sorted(by_number))
    complete = sorted(by_number) == list(range(1, len(by_number) + 1))
    return whole if complete and by_number[len(by_number)]["total"] == len(whole) else None


def _decode(column: str, message):
    names = [f.split()[0] for f in WHOLE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(n) for n in names[:6]]
            kinds = batch.column("kind").to_pylist()
            messages = [message(v.as_py()) for v in batch.column(column)]
            made = [None if k == "revisit" else payload_of(m) for k, m in zip(kinds, messages, strict=True)]
            digests = [None if p is None else hashlib.sha1(p).hexdigest() for p in made]
            announced = batch.column("digest").to_pylist()
            intact = [m is not None and (k == "revisit" or (d is not None and d == (w or d))) for k, m, d, w in zip(kinds, messages, digests, announced, strict=True)]
            sizes = [None if p is None else len(p) for p in made]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(intact, pa.bool_()), pa.array(made, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names)

    return run


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: whole payloads of responses, and revisits without one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    rows = files.mapInArrow(parse, RECORD)
    whole = rows.where("segment IS NULL OR NOT sound").select(*HEAD, F.when(F.col("sound"), F.col("block")).alias("block"))
    whole = whole.mapInArrow(_decode("block", lambda b: b), WHOLE)
    head = F.struct(*HEAD)
    orphan = F.struct(*[(F.col("origin") if c == "record_id" else F.lit(None).cast("bigint" if c == "key" else "string")).alias(c) for c in HEAD])
    # A group is one payload, which was one row before it was cut.
    cut = rows.where("segment IS NOT NULL AND sound").groupBy(F.coalesce("origin", "record_id").alias("origin")).agg(
        F.max(F.when(F.col("segment") == 1, head)).alias("head"), F.collect_list(F.struct("segment", "total", "block")).alias("segments")
    )
    joined = cut.withColumn("head", F.coalesce("head", orphan)).select("head.*", "segments").mapInArrow(_decode("segments", message_of), WHOLE)
    return whole.unionByName(joined)


def with_revisits(found: DataFrame) -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to (a key) from narrow rows; revisits take theirs from the response."""
    responses = found.where("kind = 'response'")
    origins = responses.select(F.col("record_id").alias("refers_to"), F.col("key").alias("origin"), "payload_bytes", "payload_digest")
    revisits = found.where("kind = 'revisit'").select("key", "refers_to").join(origins, "refers_to", "left")
    return responses.select("key", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to")).unionByName(
        revisits.select("key", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("origin").alias("refers_to"))
    )
