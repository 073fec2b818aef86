"""Texts of Arrow batches, word shingles and small helpers the operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a text whose words are held at one time.
BLOCK_BYTES = 1 << 22

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns as `id` and `text`; a null text becomes empty. Other columns are not read."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def strings(column: pa.Array) -> list[str]:
    return ["" if text is None else text for text in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if data is None else data for data in column.cast(kind).to_pylist()]


def arrow_map(
    df: DataFrame, schema: str, columns: Callable[[pa.RecordBatch], list[pa.Array]], names: list[str]
) -> DataFrame:
    """`mapInArrow` with a function from a batch to the arrays of its result."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(columns(batch), names)

    return df.mapInArrow(run, schema)


def word_blocks(data: bytes, carry: int, block: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Words of a text (runs without blank, tab or line break), a bounded block at a time.

    Every block after the first begins with the last `carry` words of the one before.
    """
    kept: list[bytes] = []
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > block:
            gap = _SPACE.search(data, at + block)
            end = gap.end() if gap else end
        words = kept + data[at:end].split()
        yield words
        kept = words[max(0, len(words) - carry):] if carry else []
        at = end


def shingle_hashes(data: bytes, size: int, seed: int, block: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """XXH64 of every run of `size` words joined by blanks, in order, as arrays of uint64.

    A text of fewer words gives one hash of its whole sequence; a text without words gives none.
    """
    hashed = xxhash.xxh64_intdigest
    total = 0
    held: list[bytes] = []
    for words in word_blocks(data, size - 1, block):
        if len(words) < size:
            held = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        count = len(words) - size + 1
        pairs = zip(starts[:count].tolist(), ends[size - 1:].tolist())
        yield np.fromiter((hashed(joined[a:b], seed) for a, b in pairs), np.uint64, count)
        total += count
    if not total and held:
        yield np.array([hashed(b" ".join(held), seed)], np.uint64)


def lower_ascii(data: bytes) -> bytes:
    """A-Z lower-cased, every other character untouched (`bytes.lower` knows ASCII only)."""
    return data.lower()


def labelled_sample(rows: DataFrame, each: int) -> DataFrame:
    """id, label and place (1 to `each`) of a bounded sample of rows (id, label), settled by a hash of the ids.

    Labels are few. Each one's rows are first thinned by another hash to about twice what is wanted, in place,
    so that choosing the last ones is small work for any label.
    """
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.select("id", "label", F.lit(1).alias("place")).limit(0)
    shares = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, 2 * each / n + 100 / n))])
    drawn = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < shares[F.col("label")] * (1 << 30)
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    thinned = rows.select("id", "label").where(drawn).distinct()
    return thinned.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
