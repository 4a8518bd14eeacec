"""WARC archives: writing with segmentation, reading with segment reassembly (operator 6).

``write`` turns pages into WARC/1.1 records with HTTP blocks in chunked transfer framing; a block
longer than ``segment_bytes`` becomes a record and its continuations. Files are written by Spark's
text writer, with the CRLF CRLF that ends a record as its line separator, so any store Spark
writes to will do. ``read_records`` parses such files, gzipped or not. ``reassemble`` groups
continuation records by origin identifier, orders them by segment number and verifies the total
length; ``payloads`` takes off HTTP header and chunk framing and verifies the payload's digest.

Equal payloads: the groups of more than one page are aggregated first (one row per payload and
task), and only they are joined back.

Defined results: a null html is an empty payload; a null url is written as an empty one; a null
page_id is written as ``null`` and read as null, and is the target of a revisit only if no other
page has that payload, in which case all of them are responses. Rows equal to the response in
page_id and payload are responses too. Extra columns are ignored, whatever their names. A page may be of any
length; files are inflated piece by piece, so only a record's block and a page are held whole. A record that is incomplete, has a wrong length or a wrong
digest is kept, with ``problem`` set and no payload. An empty table writes and gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokeloom import runtime

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def page_of(identifier: str | None) -> int | None:
    part = identifier.split(":")[2] if identifier else "null"
    return None if part == "null" else int(part)


def chunked(payload: bytes, size: int) -> bytes:
    """A payload in HTTP/1.1 chunked framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [f"{len(part):x}".encode(), CRLF, part, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def unchunk(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size or body[end + 2 + size : end + 4 + size] != CRLF:
            raise ValueError("a chunk is cut off")
        parts.append(part)
        at = end + 4 + size


def clean(value: str) -> str:
    return " ".join(value.split())


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A WARC record without the CRLF CRLF that ends it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"".join([b"WARC/1.1\r\n", head.encode(), f"Content-Length: {len(block)}\r\n\r\n".encode(), block])


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    digest = b32(hashlib.sha1(payload).digest())
    own = record_id(page_id, digest)
    common = {"WARC-Date": DATE, "WARC-Target-URI": clean(url or ""), "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if is_revisit:
        head = {"WARC-Type": "revisit", "WARC-Record-ID": own, "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest)}
        yield record(head | common, status + f"Content-Length: {len(payload)}\r\n\r\n".encode())
        return
    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    head = {"WARC-Type": "response", "WARC-Record-ID": own}
    if len(parts) == 1:
        yield record(head | common, block)
        return
    yield record(head | common | {"WARC-Segment-Number": 1}, parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = k == len(parts)
        yield record(
            {"WARC-Type": "continuation", "WARC-Record-ID": f"{own[:-1]}:{k}>", "WARC-Date": DATE, "WARC-Target-URI": common["WARC-Target-URI"], "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": k, "WARC-Segment-Total-Length": len(block) if last else None},
            part,
        )


def with_targets(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, target: the page a revisit refers to, null for responses."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = base.withColumn("_key", F.sha1("html"))
    groups = keyed.filter(F.octet_length("html") >= least_bytes).groupBy("_key").agg(F.max("page_id").alias("_target"), F.count(F.lit(1)).alias("_n"))
    several = runtime.table(groups.filter("_n > 1 and _target is not null").select("_key", "_target"))
    joined = keyed.join(runtime.bounded_broadcast(several), "_key", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_target")), F.col("_target")).alias("target"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = 16_384, chunk_bytes: int = 4_096, records_per_file: int = 20_000) -> None:
    """Write an archive of pages (page_id, url, html) as gzipped WARC files under path."""
    runtime.ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page_id, url, html, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in page_records(page_id, url, html.encode(), target, target is not None, segment_bytes, chunk_bytes):
                    out.append(r)
                    size += len(r)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = with_targets(pages, least_bytes).mapInArrow(run, "record binary")
    writer = records.select(F.col("record").cast("string").alias("value")).write
    writer.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


#: Bytes of a file that are inflated at once; a record's block is held whole.
PIECE_BYTES = 4 << 20


def inflate(content: bytes, piece: int = PIECE_BYTES) -> Iterator[bytes]:
    """The content of a gzip file of any number of members piece by piece, or what was given if it isn't gzip."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        member = zlib.decompressobj(31)
        part = member.decompress(content, piece)
        while part or (member.unconsumed_tail and not member.eof):
            yield part
            part = b"" if member.eof else member.decompress(member.unconsumed_tail, piece)
        content = member.unused_data


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file, whose bytes come piece by piece."""
    pieces, held, passed = iter(pieces), bytearray(), 0

    def more() -> bool:
        part = next(pieces, None)
        held.extend(part or b"")
        return part is not None

    while held or more():
        while len(held) < 5 and more():
            pass
        if not held:
            break
        if held[:5] != b"WARC/":
            raise ValueError(f"no record at byte {passed}")
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError(f"the record at byte {passed} is cut off")
        fields = {}
        for line in held[:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        while len(held) < end + 8 + n and more():
            pass
        if held[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {passed} is cut off")
        yield fields, bytes(held[end + 4 : end + 4 + n])
        del held[: end + 8 + n]
        passed += end + 8 + n


RECORD_SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, origin_id string, segment_number long, total_length long, block binary"
FIELDS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length")
RECORD_TYPES = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.binary()]
RECORD_NAMES = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]


def read_records(spark, path: str) -> DataFrame:
    """Every record of the WARC files under path."""
    runtime.ship(spark)

    def flush(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), RECORD_TYPES, strict=True)], names=RECORD_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found, size = [], 0
                for fields, block in parse_records(inflate(content.as_py())):
                    values = [fields.get(f) for f in FIELDS]
                    values[6:] = [None if v is None else int(v) for v in values[6:]]
                    found.append((*values, block))
                    size += len(block)
                    if size > 4_000_000:
                        yield flush(found)
                        found, size = [], 0
                if found:
                    yield flush(found)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per logical record: its heading, ``copies`` of it, its segments in order and the total length that they must have.

    Only records with a segment number are shuffled. Segments of one number are the same bytes
    written twice, for rows written twice; one is taken.
    """
    head = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")
    whole = records.filter("segment_number is null").select(*head, F.lit(1).cast("long").alias("copies"), F.array("block").alias("segments"), F.lit(0).cast("long").alias("missing"), F.lit(None).cast("long").alias("total_length"))
    parts = records.filter("segment_number is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    one = parts.groupBy("origin", "segment_number").agg(
        *(F.max(F.when(F.col("segment_number") == 1, F.col(c))).alias(c) for c in head), F.count(F.lit(1)).alias("copies"), F.first("block").alias("block"), F.max("total_length").alias("total_length")
    )
    grouped = one.groupBy("origin").agg(
        *(F.max(c).alias(c) for c in head),
        F.max(F.when(F.col("segment_number") == 1, F.col("copies"))).alias("copies"),
        F.sort_array(F.collect_list(F.struct("segment_number", "block"))).alias("s"),
        F.max("total_length").alias("total_length"),
        F.max("segment_number").alias("most"),
    )
    joined = grouped.select(*head, F.coalesce("copies", F.lit(1)).alias("copies"), F.col("s.block").alias("segments"), (F.col("most") - F.size("s")).alias("missing"), F.coalesce("total_length", F.lit(-1)).alias("total_length"))
    return whole.unionByName(joined)


PAYLOAD_SCHEMA = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, problem string"
PAYLOAD_NAMES = [x.split()[0] for x in PAYLOAD_SCHEMA.split(", ")]
PAYLOAD_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]


def decode(kind: str | None, segments: list[bytes], missing: int, total: int | None, digest: str | None) -> tuple[int | None, str | None, bytes | None, str | None]:
    """Length, digest and bytes of the payload, or what is wrong. A revisit has length and digest only."""
    block = b"".join(segments)
    if missing:
        return None, None, None, "a segment is missing"
    if total is not None and total != len(block):
        return None, None, None, "the total length is wrong"
    try:
        end = block.index(b"\r\n\r\n")
        fields = dict(line.lower().split(b": ", 1) for line in block[:end].split(CRLF)[1:])
        body = block[end + 4 :]
        if kind == "revisit":
            return int(fields[b"content-length"]), (digest or "").removeprefix("sha1:"), None, None
        payload = unchunk(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    except (ValueError, KeyError) as e:
        return None, None, None, f"the block can't be read: {e}"
    found = b32(hashlib.sha1(payload).digest())
    if digest is not None and digest != f"sha1:{found}":
        return None, None, None, "the digest is wrong"
    return len(payload), found, payload, None


def payloads(records: DataFrame, with_bytes: bool = True) -> DataFrame:
    """A row per logical record, with the decoded payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, own, uri, refers, digest, copies, segments, missing, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, found, payload, problem = decode(kind, segments, missing, total, digest)
                row = (page_of(own), uri, kind, page_of(refers), n, found, payload if with_bytes else None, problem)
                out += [row] * copies
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PAYLOAD_TYPES, strict=True)], names=PAYLOAD_NAMES)

    return reassemble(records).mapInArrow(run, PAYLOAD_SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    path = runtime.shared_dir(spark)
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return payloads(read_records(spark, path), with_bytes=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> target THEN target END AS refers_to
FROM (SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, sha1(p) AS h, max(page_id) OVER (PARTITION BY sha1(p)) AS target
      FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))
"""
