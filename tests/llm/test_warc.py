"""Operator 6: round trips, and archives that were tampered with."""

import base64
import hashlib
from collections import Counter

import pytest

from strokeloom import runtime
from strokeloom.llm import warc

SCHEMA = "page_id long, url string, html string, extra int"
PAGES = [(i, f"http://h{i % 3}/\r\nx: y", "é<p>" * (i * 37) + "\r\n\r\nWARC/1.1\r\n\r\n", 1) for i in range(30)]
PAGES += [(100 + i, None, "same payload " * 50, None) for i in range(40)] + [(200, "u", None, 1), (201, "u", "", 1), (None, "u", "own", 1), (300, "u", "x" * 100_000, 1)]
PAGES += [(139, None, "same payload " * 50, None), (None, "u", "nobody", 1), (None, "v", "nobody", 1), (300, "u", "x" * 100_000, 1), (300, "u", "another text of 300", 1)]


def expected(pages, least=0):
    most = {}
    for p, _, h, _ in pages:
        if p is not None and len((h or "").encode()) >= least:
            most[h or ""] = max(most.get(h or "", p), p)
    out = []
    for p, _, h, _ in pages:
        raw = (h or "").encode()
        target = most.get(h or "")
        revisit = target is not None and target != p
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", target if revisit else None))
    return Counter(out)


@pytest.mark.parametrize("least,segment,chunk", [(0, 16_384, 4096), (10, 64, 7), (10**9, 333, 1000)])
def test_round_trip(spark, least, segment, chunk):
    path = runtime.shared_dir(spark)
    warc.write(spark.createDataFrame(PAGES, SCHEMA).repartition(4), path, least, segment, chunk, records_per_file=25)
    got = warc.payloads(warc.read_records(spark, path)).collect()
    assert not [r.problem for r in got if r.problem]
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(PAGES, least)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest and len(r.payload) == r.payload_bytes


def test_lost_and_altered_segments_are_found(spark):
    path = runtime.shared_dir(spark)
    warc.write(spark.createDataFrame([(i, "u", f"{i}" * 1000, 1) for i in range(6)], SCHEMA), path, segment_bytes=200)
    records = warc.read_records(spark, path).cache()
    first = "record_id like '<urn:page:0:%' or record_id like '<urn:page:1:%'"
    lost = records.filter("not (record_id like '<urn:page:0:%' and segment_number = 2) and not (record_id like '<urn:page:1:%' and total_length is not null) and not (record_id like '<urn:page:2:%' and segment_number = 1)")
    got = {r.page_id: r.problem for r in warc.payloads(lost).collect() if r.page_id is not None}
    assert got[0] == "a segment is missing" and got[1] == "the total length is wrong" and got[3] is None
    assert sum(r.problem is not None for r in warc.payloads(lost).collect()) == 3
    assert records.filter(first).count() > 4
    altered = records.withColumn("block", warc.F.expr("case when record_id like '<urn:page:4:%' and segment_number = 3 then cast(translate(cast(block as string), '4', '5') as binary) else block end"))
    assert {r.page_id: r.problem for r in warc.payloads(altered).collect()}[4] == "the digest is wrong"


def test_chunked_framing():
    for n in (0, 1, 7, 8, 9, 100):
        assert warc.unchunk(warc.chunked(b"ab\r\n0\r\n" * n, 8)) == b"ab\r\n0\r\n" * n
    assert warc.unchunk(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nabc\r\n")


def test_empty_table(spark):
    path = runtime.shared_dir(spark)
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.payloads(warc.read_records(spark, path)).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_files_are_read_piece_by_piece(piece):
    import gzip

    raw = b"".join(r + b"\r\n\r\n" for k in range(6) for r in warc.page_records(k, f"u{k}", bytes([97 + k]) * 50 * k, None, False, 64, 16))
    zipped = gzip.compress(raw[:200]) + gzip.compress(raw[200:])
    whole = list(warc.parse_records([raw]))
    assert b"".join(warc.inflate(zipped, piece)) == raw and len(whole) > 6
    assert list(warc.parse_records(warc.inflate(zipped, piece))) == whole
    assert list(warc.parse_records(raw[i : i + piece] for i in range(0, len(raw), piece))) == whole
    for bad in (raw[:-5], raw[:30], b"x" + raw):
        with pytest.raises(ValueError):
            list(warc.parse_records([bad]))
