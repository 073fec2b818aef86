"""WARC archives compressed with a Zstandard dictionary.

A file begins with a skippable frame that holds the dictionary; every record after it is a frame of its own, compressed
with that dictionary, so a record is read alone and any reader of the file has all it needs. The dictionary is built
once for all files from a bounded sample of the records to be written (about `SAMPLE` rows, `SAMPLE_BYTES` of each);
it changes the size of the files, never their content. A sample too small to train on serves as the dictionary itself.

Pages of equal payload (by SHA-256, if of at least `least_bytes`) are found by a group of digests, combined before the
shuffle; then each page learns which one its group refers to, and tasks write files where their rows lie. A file ends at
`FILE_BYTES`. The manifest, written by Spark, lists the files of successful tasks only.

Defined results: a null payload is empty; a null page_id is smaller than every other; of equal payloads every row with the
largest page_id is a response; a null url, or one with line breaks or other control characters, is written without them, and
an empty one as `urn:page:` and the page_id; an empty table gives no file; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.text import utf8
from filigree.session import materialize, open_uri, scratch_path

#: First bytes of the skippable frame with the dictionary: a fixed value of the format.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, SEED = 1_000, 8_192, 112_640, 7
#: Length of the segments the dictionary is put together from; given, so that no search for it is made.
SEGMENT = 256
LEVEL = 3
FILE_BYTES = 1 << 28
#: Bytes read from a file at a time.
READ_BYTES = 1 << 16
_CONTROLS = dict.fromkeys([*range(0x21), 0x7F, 0x85, 0x2028, 0x2029])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _block(headers: list[tuple[str, str]], first: str, body: bytes = b"") -> bytes:
    return "".join([f"{first}\r\n", *(f"{name}: {value}\r\n" for name, value in headers), "\r\n"]).encode() + body


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, revisit: bool, date: str) -> bytes:
    """A response, or a revisit of the response of page `keeper`; both name the digest and length of the full payload."""
    target = (url or "").translate(_CONTROLS) or f"urn:page:{page_id}"
    http = _block([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK",
                  b"" if revisit else payload)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http))),
        *([] if page_id is None else [("Page-ID", str(page_id))]),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(keeper)),
                    *([] if keeper is None else [("Refers-To-Page-ID", str(keeper))])]
    return _block(headers, VERSION, http + b"\r\n\r\n")


def parse_block(data: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, headers by lower-case name, and what follows the empty line."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    return first, {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}, rest


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of its HTTP message and the body of that. Lengths and the digest of a response must fit."""
    version, headers, rest = parse_block(data)
    length = int(headers["content-length"])
    if version != VERSION or rest[length:] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    if not headers["content-type"].startswith("application/http"):
        return headers, {}, rest[:length]
    _, http, body = parse_block(rest[:length])
    if headers["warc-type"] == "response":
        if len(body) != int(http["content-length"]) or headers["warc-payload-digest"] != f"sha1:{payload_digest(body)}":
            raise ValueError("payload does not fit its digest")
    return headers, http, body


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=8).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b"".join(samples)[-size:]


class ArchiveWriter:
    """One file: the dictionary in a skippable frame, then a frame for each record."""

    def __init__(self, fs: pafs.FileSystem, path: str, dictionary: bytes, info: bytes):
        self.sink = fs.open_output_stream(path, compression=None)
        self.frames = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        self.size = 0
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        self.add(info)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.frames.compress(data))

    def close(self) -> None:
        self.sink.close()


def read_archive(source: io.RawIOBase | pa.NativeFile) -> Iterator[bytes]:
    """Records of a file in order, with nothing but the file itself; one record is held at a time."""
    magic, length = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    dictionary = source.read(length)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    held = source.read(READ_BYTES)
    while held:
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(held))
            if frame.eof:
                held = frame.unused_data or source.read(READ_BYTES)
                break
            held = source.read(READ_BYTES)
            if not held:
                raise ValueError("file ends inside a record")
        yield b"".join(parts)


def with_keepers(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, html, keeper (the largest page_id of its payload) and revisit of every page."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha2("html", 256))))
    repeated = (
        rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("pages"))
        .where("pages > 1").select("digest", "keeper")
    )
    repeated = materialize(repeated, "repeated-payloads").withColumn("again", F.lit(True))
    joined = rows.join(repeated, "digest", "left")
    revisit = F.col("again").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "html", "keeper", revisit.alias("revisit"))


def sample_dictionary(pages: DataFrame, date: str) -> bytes:
    """The dictionary from a bounded sample: the records of about `SAMPLE` rows drawn where they lie, at most twice as many."""
    share = SAMPLE / max(1, pages.count())
    drawn = pages.select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html")).where(F.rand(SEED) < share)
    return trained([record(r.page_id, r.url, r.html.encode()[:SAMPLE_BYTES], None, False, date) for r in drawn.limit(2 * SAMPLE).collect()])


def write_archives(
    pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write a record for every row of `pages` (page_id, url, html) below `folder` (default: a new one in the shared folder).

    Returns the manifest: path, records and bytes of each file.
    """
    spark = pages.sparkSession
    folder = (folder or scratch_path(spark, "warc")).rstrip("/")
    rows = with_keepers(pages, least_bytes)
    plain = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html"), F.lit("")).alias("html"))
    shared = spark.sparkContext.broadcast(sample_dictionary(plain, date))
    info = _block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None)), ("WARC-Date", date),
                   ("Content-Type", "application/warc-fields"), ("Content-Length", "18")], VERSION, b"format: WARC/1.1\r\n\r\n\r\n")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, records = None, "", 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "keeper", "revisit")]
            for page_id, url, keeper, revisit, payload in zip(*columns, utf8(batch.column("html"))):
                if writer is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                    fs, place = open_uri(path)
                    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    writer, records = ArchiveWriter(fs, place, shared.value, info), 0
                writer.add(record(page_id, url, payload, keeper, revisit, date))
                records += 1
                if writer.size >= file_bytes:
                    yield finished(writer, path, records)
                    writer = None
        if writer is not None:
            yield finished(writer, path, records)

    def finished(writer: ArchiveWriter, path: str, records: int) -> pa.RecordBatch:
        writer.close()
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([writer.size], pa.int64())],
                                          ["path", "records", "bytes"])

    rows.mapInArrow(write, "path string, records bigint, bytes bigint").write.parquet(f"{folder}/manifest")
    return manifest_of(spark, folder)


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The page records of the files of a manifest: page_id, url, record_type, payload_bytes, payload_digest, refers_to, and the
    payload (null for a revisit). A file is one row of work."""
    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = open_uri(path)
                with fs.open_input_stream(place, compression=None) as source:
                    held, size = [], 0
                    for data in read_archive(source):
                        headers, http, body = parse_record(data)
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        held.append((number(headers.get("page-id")), headers["warc-target-uri"], kind, int(http["content-length"]),
                                     headers["warc-payload-digest"].removeprefix("sha1:"), number(headers.get("refers-to-page-id")),
                                     body if kind == "response" else None))
                        size += len(body)
                        if len(held) >= 1000 or size >= 1 << 24:
                            yield batch_of(held)
                            held, size = [], 0
                    if held:
                        yield batch_of(held)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), kinds)], names)

    files = manifest.select("path")
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
    return files.repartition(max(1, files.count()), "path").mapInArrow(read, schema)


def oracle_sql() -> str:
    """The query over the given table in SQL; base32 is made from 5 hexadecimal digits (four characters) at a time."""
    return """
        with p as (
            select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as keeper from pages),
        d as (select *, sha1(html) as hex from p),
        quad as (select *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::bigint) as parts from d)
        select page_id, strlen(html)::bigint as payload_bytes,
               list_aggregate(list_transform(parts, lambda v:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1)
                   || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
                   || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1)
                   || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), 'string_agg', '') as payload_digest,
               case when page_id is not distinct from keeper then 'response' else 'revisit' end as record_type,
               case when page_id is distinct from keeper then keeper end as refers_to
        from quad"""
