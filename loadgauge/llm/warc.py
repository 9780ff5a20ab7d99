"""WARC archives of pages: written with segments and revisits, read back and reassembled.

The writer keeps one response per payload; later pages with equal payloads are revisit records
that refer to it.  Payloads travel in chunked transfer framing; blocks above a size are cut into
a first record and continuation records.  Records are rows of Spark's text writer, whose line end
is the end of a WARC record, so that archives go to any store Spark writes to and survive lost
tasks.  The reader parses each archive by the lengths that its records state, groups
continuations by the identifier of their origin, orders them by segment number, verifies the
total length and takes the framing off.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadgauge.llm.common import with_row_key
from loadgauge.plans.joining import settle
from loadgauge.session import shared_folder

SEGMENT = 32 * 1024
CHUNK = 8 * 1024
LEAST_REVISIT = 100
RECORDS_PER_FILE = 4000
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_NAMESPACE = uuid.UUID("6f1c1f70-6c3c-5d0e-9f3a-0d6a3f8f2b11")


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(key))}>"


def char_cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes, never inside a UTF-8 character."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in char_cuts(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(chunk)
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(kind: str, ident: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", DATE), *fields, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def records_of(
    key: int, page_id: int | None, url: str | None, html: str | None, first: int | None, segment: int = SEGMENT
) -> Iterator[bytes]:
    """The records of one page, each without the blank lines at its end; ``key`` names them, ``first`` a page revisited."""
    payload = (html or "").encode()
    ident = record_id(key)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields: list[tuple[str, object]] = [
        ("WARC-Target-URI", uri), *([] if page_id is None else [("X-Page-ID", page_id)]),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
    ]
    if first is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record("revisit", ident, [*fields, ("WARC-Profile", profile), ("WARC-Refers-To", record_id(first))], _HTTP)
        return
    block = _HTTP + chunked(payload)
    parts = list(char_cuts(block, segment))
    if len(parts) == 1:
        yield _record("response", ident, fields, block)
        return
    yield _record("response", ident, [*fields, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        more: list[tuple[str, object]] = [("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", n)]
        if n == len(parts):
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield _record("continuation", record_id(f"{key}/{n}"), more, part)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, segment: int = SEGMENT) -> None:
    """Write page_id, url, html as gzipped archives in ``folder``.

    Of pages with equal payloads of at least ``least`` bytes, those with the smallest page_id are
    responses, pages with a larger one revisit the first of them.  Every row has a record of its
    own: rows that repeat a page_id share what the archive says of it, rows without one are
    responses and have no such field.  Null html is an empty payload, a null url an empty address.
    An empty table writes an empty folder.
    """
    pages = with_row_key(pages.select("page_id", "url", "html"), "page_id", "key")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.filter((F.octet_length("html") >= least) & F.col("page_id").isNotNull())
    narrow = settle(narrow.select("key", "page_id", F.sha2(payload, 256).alias("digest")))
    groups = narrow.groupBy("digest").agg(
        F.min("key").alias("first"), F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")
    )
    groups = groups.filter("last_id > first_id").select("digest", "first", "first_id")
    later = settle(narrow.join(groups, "digest").filter("page_id > first_id").select("key", "first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for row in zip(*batch.columns, strict=True):
                for record in records_of(*[value.as_py() for value in row], segment=segment):
                    out.append(record)
                    held += len(record)
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    rows = pages.join(later, "key", "left").select("key", "page_id", "url", "html", "first")
    writer = rows.mapInArrow(run, "value string").write.option("lineSep", END.decode()).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).option("zlib.compress.level", "BEST_SPEED").text(folder)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive, gzipped or not.

    Gzip members may hold one record each or the whole archive.
    """
    while data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            parts.append(member.decompress(rest))
            rest = member.unused_data
        data = b"".join(parts)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.index(END, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} ends early")
        yield fields, block
        at = end + 4 + size


_READ = (
    "record_id string, page_id long, record_type string, stated_digest string, refers_to_id string, "
    "origin string, segment int, total long, block binary, payload_bytes long, payload_digest string"
)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record: whole responses are digested at once, segments keep their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("stated_digest", pa.string()),
             ("refers_to_id", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()),
             ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
        )
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse(content.as_py()):
                    number = fields.get("warc-segment-number")
                    page, total = fields.get("x-page-id"), fields.get("warc-segment-total-length")
                    row = [
                        fields["warc-record-id"], None if page is None else int(page), fields["warc-type"],
                        fields.get("warc-payload-digest", "").removeprefix("sha256:"), fields.get("warc-refers-to"),
                        None, None, None if total is None else int(total), None, None, None,
                    ]
                    if number is not None:
                        row[5:9] = [fields.get("warc-segment-origin-id", row[0]), int(number), row[7], block]
                    elif row[2] == "response":
                        payload = payload_of(block)
                        row[9:11] = [len(payload), hashlib.sha256(payload).hexdigest()]
                    rows.append(row)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, _READ)


def reassembled(segments: DataFrame) -> DataFrame:
    """Segments -> record_id, page_id, payload_bytes, payload_digest, damage: a row per origin.

    ``damage`` says what is wrong with an origin whose numbers have gaps or repeat with different
    blocks, whose total length differs or is missing, or whose framing breaks; null if nothing is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for parts, total in zip(batch.column(2), batch.column(3), strict=True):
                blocks = parts.as_py()
                size, digest, damage = None, None, None
                if [b["segment"] for b in blocks] != list(range(1, len(blocks) + 1)):
                    damage = "segments missing or doubled"
                else:
                    whole = b"".join(b["block"] for b in blocks)
                    if total.as_py() != len(whole):
                        damage = f"length {len(whole)}, stated {total.as_py()}"
                    else:
                        try:
                            payload = payload_of(whole)
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        except ValueError as broken:
                            damage = f"framing: {broken}"
                for column, value in zip(out, (size, digest, damage), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
                ["record_id", "page_id", "payload_bytes", "payload_digest", "damage"],
            )

    parts = segments.groupBy("origin").agg(
        F.max("page_id").alias("page_id"),
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
    )
    schema = "record_id string, page_id long, payload_bytes long, payload_digest string, damage string"
    return parts.select("origin", "page_id", "parts", "total").mapInArrow(run, schema)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, damage: a row per page record.

    Revisits take size and digest of the response they refer to; ``damage`` tells of segments that
    do not add up, digests that differ from the stated one, and revisits of nothing.
    """
    records = settle(_records(spark, folder))
    single = records.filter("segment is null and record_type = 'response'").select(
        "record_id", "page_id", "payload_bytes", "payload_digest", F.lit(None).cast("string").alias("damage"), "stated_digest"
    )
    stated = records.filter("segment = 1").select("record_id", "stated_digest")
    joined = reassembled(records.filter("segment is not null")).join(stated, "record_id", "left")
    responses = single.unionByName(joined)
    wrong = F.when(F.col("stated_digest") != F.col("payload_digest"), "digest differs from the stated one")
    responses = settle(responses.withColumn("damage", F.coalesce("damage", wrong)))
    target = responses.select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest", F.lit(True).alias("found")
    )
    revisits = records.filter("record_type = 'revisit'").select("page_id", "refers_to_id", "stated_digest")
    revisits = revisits.join(target, "refers_to_id", "left")
    damage = F.when(F.col("found").isNull(), "refers to no response").when(
        F.col("payload_digest") != F.col("stated_digest"), "digest differs from the stated one"
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "damage"]
    revisits = revisits.withColumn("record_type", F.lit("revisit")).withColumn("damage", damage)
    responses = responses.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long"))
    return responses.select(columns).unionByName(revisits.select(columns))


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return read_archives(spark, folder)
