"""Token ids in Arrow files of equal-length sequences with masks.

Documents are dealt by range of their id and sorted, so the files in order hold all documents in
ascending order. A file is an Arrow IPC file with two fixed-size-list columns: `ids` and `mask` (a bit: true for
a token, false for the filling of the last sequence). Any sequence is reached at its place in
constant time, and a memory-mapped file is read without a copy. A second file beside it holds
doc_id, start and n_tokens of the documents inside. The manifest, written by Spark, lists the files of
successful tasks only, so a task that is run again leaves nothing that a reader would see.

Defined results: a text that spells out an added token of the vocabulary holds its id, as the library does by default; a null or empty
text is the end id alone; null ids of documents come first; rows of
one id follow each other by the hash of their text; an empty table gives a manifest without rows;
other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from filigree.llm.pretokens import IdCache, Splitter, split_patterns
from filigree.llm.text import id_and_text, strings
from filigree.session import open_uri, scratch_path

SEQUENCE = 2048
#: Sequences of a record batch.
BATCH = 256
#: The split pattern of the byte-level pre-tokenizer, a fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def class_members(name: str) -> set[int]:
    """Code points below 256 that the tokenizers library puts in a class."""
    split = pre_tokenizers.Split(Regex(name), "removed")
    return {point for point in range(256) if not split.pre_tokenize_str(chr(point))}


class Encoder:
    """Ids of texts by a tokenizer file, as the library gives them. Pre-tokens are remembered where the file is plain byte-level BPE."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(definition)
        # Pre-tokens of a text without added tokens hold none, so the search for them is left out, which is much of a short word's time.
        self.words = Tokenizer.from_str(definition)
        self.words.encode_special_tokens = True
        parsed = json.loads(definition)
        added = [token["content"] for token in parsed.get("added_tokens", []) if token["content"]]
        # Texts that spell out an added token go to the library whole, which finds it before it splits.
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        split = parsed.get("pre_tokenizer") or {}
        self.plain = (
            not parsed.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
            and split.get("use_regex", True)
        )
        self.splitter = Splitter(split_patterns(BYTE_LEVEL, class_members)[0], "(?!)")
        self.cache = IdCache(lambda words: self._encode(self.words, words))

    @staticmethod
    def _encode(tokenizer: Tokenizer, texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, "<u4").tobytes() for one in found]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; other than Latin-1 texts go to the library whole."""
        if self.plain and self.splitter.is_narrow(text) and not self.added.search(text):
            return b"".join(self.cache.ids(part) for part in self.splitter.parts(text))
        return self._encode(self.tokenizer, [text])[0]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


class SequenceWriter:
    """Packs ids into sequences of fixed length and writes them in batches."""

    def __init__(self, fs: pafs.FileSystem, path: str, length: int, kind: pa.DataType):
        self.length, self.kind, self.total = length, kind, 0
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.length * BATCH:
            self._write(self.n_held // (self.length * BATCH) * BATCH)

    def _write(self, sequences: int) -> None:
        ids = np.concatenate(self.held)
        n = sequences * self.length
        self.held = [ids[n:]]
        self.n_held = max(0, len(ids) - n)
        mask = np.arange(n) < len(ids)
        if len(ids) < n:
            ids = np.concatenate((ids, np.zeros(n - len(ids), ids.dtype)))
        for at in range(0, n, self.length * BATCH):
            part = slice(at, min(n, at + self.length * BATCH))
            self.file.write_batch(pa.RecordBatch.from_arrays([
                pa.FixedSizeListArray.from_arrays(pa.array(ids[part], self.kind), self.length),
                pa.FixedSizeListArray.from_arrays(pa.array(mask[part]), self.length),
            ], schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            self._write(-(-self.n_held // self.length))
        self.file.close()
        self.sink.close()


class SequenceFile:
    """Random access to the sequences of one file; local files are mapped, not read."""

    def __init__(self, uri: str):
        fs, path = open_uri(uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size

    def batch(self, i: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of a record batch, flat; both are views of the file."""
        batch = self.file.get_batch(i)
        return batch.column("ids").flatten(), batch.column("mask").flatten()

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence i."""
        ids, mask = self.batch(i // BATCH)
        first = i % BATCH * self.length
        return ids.slice(first, self.length).to_numpy(zero_copy_only=True), mask.slice(first, self.length)

    def slices(self, lengths: Iterable[int]) -> Iterator[bytes]:
        """The unmasked ids cut into runs of the given lengths, as unsigned 32-bit integers."""
        held, number = np.zeros(0, np.uint32), 0
        for length in lengths:
            parts = [held]
            n = len(held)
            while n < length:
                ids, mask = self.batch(number)
                number += 1
                parts.append(ids.to_numpy(zero_copy_only=True)[:mask.true_count])
                n += len(parts[-1])
            joined = np.concatenate(parts) if len(parts) > 1 else held
            yield joined[:length].astype("<u4").tobytes()
            held = joined[length:]

    def close(self) -> None:
        self.source.close()


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, length: int = SEQUENCE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write the files below `folder` (default: a new one in the shared folder) and return the manifest:
    part, path, docs, n_tokens and base (tokens of all parts before)."""
    spark = docs.sparkSession
    folder = (folder or scratch_path(spark, "tokens")).rstrip("/")
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    size = Tokenizer.from_str(definition).get_vocab_size()
    shared = spark.sparkContext.broadcast(definition)
    kind = pa.uint16() if max(size, end_id + 1) <= 1 << 16 else pa.uint32()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        end = np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId():06d}-{uuid.uuid4().hex}"
        writer = index = None
        docs = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs, place = open_uri(path)
                fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                writer = SequenceWriter(fs, f"{place}.arrow", length, kind)
                schema = pa.schema([("doc_id", batch.schema.field("id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                sink = fs.open_output_stream(f"{place}.docs.arrow")
                index = pa.ipc.new_file(sink, schema)
            starts, counts = [], []
            for text in strings(batch.column("text")):
                ids = np.frombuffer(encoder.encode(text) + end, "<u4")
                starts.append(writer.total)
                counts.append(len(ids))
                writer.add(ids)
            docs += batch.num_rows
            index.write_batch(pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=schema))
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [context.partitionId()], "path": [path], "docs": [docs], "n_tokens": [writer.total]},
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("n_tokens", pa.int64())]))

    order = ["id", F.xxhash64("text")]
    rows = id_and_text(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(write, "part int, path string, docs bigint, n_tokens bigint").write.parquet(f"{folder}/manifest")
    return manifest_of(spark, folder)


def read_token_files(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Documents of the files of a manifest: id, start (tokens of all documents before), n_tokens, and the
    ids as little-endian unsigned 32-bit integers. A file is one row of work."""
    files = manifest.select("path", "base")
    n = max(1, files.count())

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, place = open_uri(f"{path}.docs.arrow")
                sequences = SequenceFile(f"{path}.arrow")
                with fs.open_input_file(place) as source:
                    index = pa.ipc.open_file(source)
                    lengths = (c for i in range(index.num_record_batches) for c in index.get_batch(i).column("n_tokens").to_pylist())
                    runs = sequences.slices(lengths)
                    for i in range(index.num_record_batches):
                        rows = index.get_batch(i)
                        for at in range(0, rows.num_rows, BATCH):
                            part = rows.slice(at, BATCH)
                            ids = [next(runs) for _ in range(part.num_rows)]
                            start = pa.array(part.column("start").to_numpy() + base, pa.int64())
                            yield pa.RecordBatch.from_arrays(
                                [part.column("doc_id"), start, part.column("n_tokens"), pa.array(ids, pa.binary())],
                                ["id", "start", "n_tokens", "ids"])
                sequences.close()

    schema = f"id {id_type}, start bigint, n_tokens bigint, ids binary"
    return files.repartition(n, "path").mapInArrow(read, schema)


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder: a row for each file, with the tokens before it. It has one row for
    hundreds of thousands of documents, so one task orders it at any size of the corpus."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    table = spark.read.parquet(f"{folder.rstrip('/')}/manifest")
    return table.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
