"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a weighted set of word shingles (five words, lower-cased, ASCII punctuation as blanks)
and its SimHash. In a document, windows are as long as an item and begin at every word; only windows that
hold a shingle of some item of that length can be similar to one, so only those get a fingerprint, from
running sums of the hash bits. Fingerprints of 64 bits are cut into blocks; by the pigeonhole rule two
that differ in at most r bits differ in at most r // blocks bits in some block, so tables of
all block values within that distance give every item within the radius. Candidates are verified by the
exact weighted Jaccard similarity of the two shingle multisets.

The benchmark is a stated query set. It is read in blocks of bounded size, and each block is held against
all documents, so a benchmark of any size is whole.

Defined results: null and empty texts, and items without a word, match nothing; an item of fewer than five
words is one shingle of all its words, held against windows of as many words; repeated rows and null ids each give
their own rows; empty tables give an empty result; other columns of the inputs are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.text import id_and_text, shingle_hashes, utf8

WORDS = 5
SIMILARITY = 0.8
#: Blocks searched to two bits each reach every fingerprint within 8 * 3 - 1 bits.
BITS, BLOCKS, RADIUS = 64, 8, 23
SEED = 42
#: Items, and bytes of their texts, that are held against the documents at one time.
ITEMS, ITEM_BYTES = 10_000, 16 << 20
#: Windows whose fingerprints are computed at one time.
WINDOWS = 1 << 14
MARK_BITS = 22

_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def plain_words(data: bytes) -> bytes:
    """Lower-cased text with every ASCII character but letters and digits as a blank."""
    return data.translate(_PLAIN)


def hashes_of(data: bytes, words: int) -> np.ndarray:
    found = list(shingle_hashes(data, words, SEED))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def bit_rows(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def window_prints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of `size` shingles that begin at `starts` (ascending, none past the last whole window)."""
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(starts), WINDOWS):
        part = starts[at:at + WINDOWS]
        first = at
        while first < at + len(part):
            last = min(at + len(part), int(np.searchsorted(starts, starts[first] + WINDOWS)))
            low, some = int(starts[first]), starts[first:last] - int(starts[first])
            rows = bit_rows(hashes[low:low + int(some[-1]) + size])
            sums = np.zeros((len(rows) + 1, BITS), np.int32)
            np.cumsum(rows, axis=0, out=sums[1:])
            ones = sums[some + size] - sums[some]
            out[first:last] = np.packbits(2 * ones > size, axis=1, bitorder="little").view(np.uint64).ravel()
            first = last
    return out


def weighted_jaccard(a: Counter, b: Counter) -> float:
    shared = (a & b).total()
    return shared / (a.total() + b.total() - shared)


class HammingIndex:
    """Multi-index over fingerprints: for each block, positions by every block value within its share of the radius."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        width = BITS // BLOCKS
        values = np.arange(1 << width, dtype=np.uint64)
        self.tables = []
        for block in range(BLOCKS):
            own = (prints >> np.uint64(block * width)) & np.uint64((1 << width) - 1)
            near = np.bitwise_count(values[:, None] ^ own[None, :]) <= RADIUS // BLOCKS
            self.tables.append(np.packbits(near, axis=1))

    def search(self, print_: int) -> np.ndarray:
        """Positions of all fingerprints within the radius."""
        width = BITS // BLOCKS
        bits = self.tables[0][print_ & ((1 << width) - 1)]
        for block in range(1, BLOCKS):
            bits = bits | self.tables[block][(print_ >> (block * width)) & ((1 << width) - 1)]
        maybe = np.flatnonzero(np.unpackbits(bits, count=len(self.prints)))
        return maybe[np.bitwise_count(self.prints[maybe] ^ np.uint64(print_)) <= RADIUS]


class Benchmark:
    """Items of one block, by the words of their shingles and the number of these."""

    def __init__(self, items: list[tuple]):
        self.by_words: dict[int, BenchmarkWords] = {}
        grouped: dict[int, list] = defaultdict(list)
        for item, text in items:
            data = plain_words(text)
            if words := len(data.split()):
                grouped[min(WORDS, words)].append((item, hashes_of(data, min(WORDS, words))))
        for words, group in grouped.items():
            self.by_words[words] = BenchmarkWords(group)

    def matches(self, data: bytes, least: float) -> list[tuple]:
        """(item, similarity, first word, shingles) of the best window of every item the text holds."""
        plain = plain_words(data)
        return [match for words, group in self.by_words.items() for match in group.matches(hashes_of(plain, words), least)]


class BenchmarkWords:
    def __init__(self, items: list[tuple]):
        self.items = items
        self.counters = [Counter(hashes.tolist()) for _, hashes in items]
        holders: dict[int, set[int]] = defaultdict(set)
        of_size: dict[int, list[int]] = defaultdict(list)
        for i, (_, hashes) in enumerate(items):
            of_size[len(hashes)].append(i)
            for h in hashes.tolist():
                holders[h].add(len(hashes))
        self.keys = np.array(sorted(holders), np.uint64)
        self.sizes_of = [sorted(holders[k]) for k in self.keys.tolist()]
        self.marks = np.zeros(1 << MARK_BITS, bool)
        self.marks[self.keys >> np.uint64(64 - MARK_BITS)] = True
        self.of_size = {}
        for size, members in of_size.items():
            prints = [window_prints(items[i][1], np.zeros(1, np.int64), size) for i in members]
            self.of_size[size] = (members, HammingIndex(np.concatenate(prints)))

    def matches(self, hashes: np.ndarray, least: float) -> list[tuple]:
        maybe = np.flatnonzero(self.marks[hashes >> np.uint64(64 - MARK_BITS)])
        if not len(maybe):
            return []
        places = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        sure = self.keys[places] == hashes[maybe]
        hits: dict[int, list[int]] = defaultdict(list)
        for at, place in zip(maybe[sure].tolist(), places[sure].tolist()):
            for size in self.sizes_of[place]:
                hits[size].append(at)
        best: dict[int, tuple[float, int]] = {}
        for size, at in hits.items():
            self._windows(hashes, np.array(at), size, least, best)
        return [(self.items[i][0], s, start, len(self.items[i][1])) for i, (s, start) in sorted(best.items())]

    def _windows(self, hashes: np.ndarray, hits: np.ndarray, size: int, least: float, best: dict) -> None:
        """Verify the windows of one size that hold a hit; a shorter text is one window of its own."""
        last = len(hashes) - size
        if last < 0:
            starts, size = np.zeros(1, np.int64), len(hashes)
            members, index = self.of_size[size - last]
        else:
            edges = np.zeros(last + 2, np.int32)
            np.add.at(edges, np.clip(hits - size + 1, 0, last), 1)
            np.add.at(edges, np.minimum(hits, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
            members, index = self.of_size[size]
        prints = window_prints(hashes, starts, size)
        for start, print_ in zip(starts.tolist(), prints.tolist()):
            window = None
            for position in index.search(print_).tolist():
                item = members[position]
                if best.get(item, (0.0, 0))[0] == 1.0:
                    continue
                window = window or Counter(hashes[start:start + size].tolist())
                if self.counters[item].keys().isdisjoint(window):
                    continue
                similarity = weighted_jaccard(self.counters[item], window)
                if similarity >= least and similarity > best.get(item, (0.0, 0))[0]:
                    best[item] = (similarity, start)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded count and size, read one block at a time."""
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(text_col, F.lit("")).alias("text"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // ITEM_BYTES))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).select("item", F.encode("text", "utf-8").alias("text")).collect()
        if rows:
            yield sorted(((r.item, bytes(r.text)) for r in rows), key=lambda x: (str(x[0]), x[1]))


_BENCHMARKS: dict[str, Benchmark] = {}


def _benchmark(shared) -> Benchmark:
    key, items = shared.value
    if key not in _BENCHMARKS:
        _BENCHMARKS.clear()
        _BENCHMARKS[key] = Benchmark(items)
    return _BENCHMARKS[key]


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item, similarity, first word and length in shingles of the best window, for every item a document holds."""
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, similarity double, start bigint, shingles bigint"
    names = ["id", "item", "similarity", "start", "shingles"]
    rows, out = id_and_text(docs, id_col, text_col), None
    for items in item_blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, items))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_benchmark(shared).matches(text, least) for text in utf8(batch.column("text"))]
                flat = [match for matches in found for match in matches]
                if flat:
                    ids = batch.column("id").take(pa.array([i for i, f in enumerate(found) for _ in f], pa.int64()))
                    item, similarity, start, shingles = map(pa.array, zip(*flat))
                    yield pa.RecordBatch.from_arrays([ids, item, similarity, start, shingles], names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`docs` without the rows that hold an item; nothing is shuffled."""
    place, schema = docs.columns.index(text_col), docs.schema
    for items in item_blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not _benchmark(shared).matches(text, least) for text in utf8(batch.column(place))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
