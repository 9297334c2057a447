import base64
import gzip
import hashlib
import random
import string

import pyarrow as pa
import pytest

from lakeloom.llm import warc as W
from lakeloom.llm.files import read_file

ROWS = [(1, "http://a/\n", "x", 0), (2, None, "x", 0), (2, None, "x", 0), (5, "u", "x", 0), (None, "u", "x", 0), (7, "u", None, 0),
        (8, "u", "", 0), (9, "u é", "é" * 300_000, 0), (10, "u", "WARC/1.1\r\n\r\n", 0)]
SCHEMA = "page_id long, url string, html string, payload int"


def expected(least):
    texts = [(i, (h or "").encode()) for i, _, h, _ in ROWS]
    out = []
    for i, raw in texts:
        same = [j for j, other in texts if other == raw and j is not None]
        target = max(same) if i is not None and len(raw) >= least else i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if target == i else "revisit", None if target == i else target))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 2])
def test_round_trip_for_any_split(spark, least):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    files = W.write(pages, least)
    for split in (1 << 24, 300, 41):
        got = W.read(spark, files, split)
        assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(least)
    big = {r.page_id: bytes(r.payload) for r in got.where("page_id >= 8").collect()}
    assert big == {8: b"", 9: ("é" * 300_000).encode(), 10: b"WARC/1.1\r\n\r\n"}


def test_archives_are_plain_gzip_with_crlf_records(spark):
    uri = W.write(spark.createDataFrame(ROWS[:1], SCHEMA)).first().uri
    with read_file(uri) as f:
        text = gzip.decompress(f.read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"WARC-Target-URI: http://a/%0A\r\n" in text
    assert text.endswith(b"\r\n\r\nx\r\n\r\n")


def members(payloads):
    return [W.record(i, f"http://h/{i}", p, None) for i, p in enumerate(payloads)]


def test_each_record_belongs_to_one_range(monkeypatch):
    rng = random.Random(1)
    noise = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 10, 3000, 500)] + [W.MAGIC * 50 + b"WARC/1.1"]
    parts = members(noise)
    raw = b"junk" + b"".join(parts) + W.MAGIC + b"no member"
    monkeypatch.setattr(W, "CHUNK", 64)
    for step in (1, 7, 100, len(raw)):
        got = [b for a in range(0, len(raw), step) for _, b in W.records(pa.BufferReader(raw), a, min(a + step, len(raw)))]
        assert [b.partition(b"\r\n\r\n")[2] for b in got] == noise


def test_broken_records_raise():
    raw = members([b"some payload " * 50])[0]
    with pytest.raises(EOFError):
        list(W.records(pa.BufferReader(raw[:-30]), 0, 10))


def test_empty_table(spark):
    files = W.write(spark.createDataFrame([], SCHEMA))
    assert files.collect() == [] and W.read(spark, files).collect() == []


def test_digest_alphabet():
    assert set(W.digest(b"")) <= set(string.ascii_uppercase + "234567") and len(W.digest(b"")) == 32
