"""WARC archives against plain Python, and read by the zstandard library alone."""

from __future__ import annotations

import base64
import hashlib
import struct

import duckdb
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from filigree.llm import warc
from filigree.llm.queries import op13_warc, table
from filigree.session import open_uri

NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def expected(rows, least=0):
    groups: dict = {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        keeper = max((p for p in groups[data] if p is not None), default=None)
        revisit = len(data) >= least and page != keeper
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response",
                    keeper if revisit else None))
    return sorted(map(repr, out))


def found_rows(frame):
    return sorted(repr(tuple(r)) for r in frame.select(NAMES).collect())


def test_query_equals_plain_python(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    assert found_rows(op13_warc(spark, sf_dir)) == expected(rows)


ODD = [
    (1, "http://a.com/", "<p>same</p>"), (2, "http://b.com/", "<p>same</p>"), (2, "http://b.com/", "<p>same</p>"), (3, None, None), (4, "", ""),
    (5, "http://c.com/x\r\nWARC-Type: fake ", "\r\n\r\nWARC/1.1\r\n"), (None, "http://d.com/é", "<p>same</p>"), (None, None, "only null"),
    (None, "x", "only null"), (6, "u", "é日本\U0001f600\x00" * 5), (7, "long", "word " * 900_000), (8, "long too", "word " * 900_000), (-3, "u", "\r\n"),
]
SCHEMA = "page_id bigint, url string, html string"


@pytest.mark.parametrize(("least", "file_bytes"), [(0, 1), (8, 1 << 28)])
def test_odd_rows(spark, clashing, least, file_bytes):
    manifest = warc.write_archives(clashing(ODD, SCHEMA), least_bytes=least, file_bytes=file_bytes)
    found = warc.read_archives(manifest)
    assert found_rows(found) == expected(ODD, least)
    urls = {r.page_id: r.url for r in found.collect()}
    assert urls[3] == "urn:page:3" and urls[5] == "http://c.com/xWARC-Type:fake"
    payloads = sorted(bytes(r.payload) for r in found.where("payload is not null").collect())
    stored = {(h or "").encode() for _, _, h in ODD}
    assert set(payloads) == stored
    files = manifest.collect()
    assert sum(r.records for r in files) == len(ODD) and (len(files) == len(ODD)) == (file_bytes == 1)
    con = duckdb.connect()
    con.register("pages", pa.table({n: [r[i] for r in ODD] for i, n in enumerate(("page_id", "url", "html"))}))
    assert sorted(repr(tuple(r)) for r in con.sql(warc.oracle_sql()).select(", ".join(NAMES)).fetchall()) == expected(ODD)


def test_empty_table_gives_no_file(spark, clashing):
    manifest = warc.write_archives(clashing(ODD, SCHEMA).where(F.lit(False)))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


def test_a_file_is_a_dictionary_frame_and_a_frame_per_record(spark, sf_dir):
    row = warc.write_archives(table(spark, sf_dir, "pages")).first()
    fs, place = open_uri(row.path)
    with fs.open_input_file(place) as source:
        data = source.read()
    assert len(data) == row.bytes
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size <= warc.DICTIONARY_BYTES
    dictionary = zstandard.ZstdCompressionDict(data[8:8 + size])
    assert dictionary.dict_id() > 0
    rest, frames = data[8 + size:], []
    while rest:
        frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        assert zstandard.get_frame_parameters(rest).dict_id == dictionary.dict_id()
        frames.append(frame.decompress(rest))
        rest = frame.unused_data
    assert len(frames) == row.records + 1 and all(f.startswith(b"WARC/1.1\r\n") and f.endswith(b"\r\n\r\n") for f in frames)
    plain = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(f)) for f in frames)
    assert len(data) - 8 - size < 0.8 * plain
    whole = next(f for f in frames if b"WARC-Type: response" in f and warc.parse_record(f)[2])
    with pytest.raises(ValueError):
        warc.parse_record(whole[:-5] + bytes([whole[-5] ^ 1]) + whole[-4:])
