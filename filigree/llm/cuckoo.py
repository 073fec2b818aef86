"""Exact deduplication through a sharded cuckoo-filter index of text digests.

Digests are dealt to shards by hash. A shard keeps a cuckoo filter of 16-bit prints, four slots a
bucket; every slot also points to the stored key it stands for. A probe that finds no equal print
proves that a digest is new. A hit is verified against the full digests its buckets point to, so
a false positive is never taken for a copy. When an insertion finds no place, the shard's filter
is made anew with twice the buckets from the stored keys. Deleting a digest clears its slot.

Defined results: a null text counts as empty; a null id is smaller than every other; rows of the
same text and the same id are the same document, each gets a row of its own with the same result;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.text import arrow_map, id_and_text, lower_ascii, utf8
from filigree.session import materialize

SLOTS = 4
MAX_KICKS = 200
#: Rows a shard is planned for; the number of shards follows the number of rows.
ROWS_PER_SHARD = 50_000
#: Partial groups a digest is split into before its shard.
SALTS = 16
MIX = 0x5BD1E995


class CuckooFilter:
    """Prints in buckets of four slots, each with a reference to its stored key."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.prints = [0] * (buckets * SLOTS)
        self.refs = [-1] * (buckets * SLOTS)

    def place(self, digest: bytes) -> tuple[int, int, int]:
        """Print and the two buckets of a digest; each bucket follows from the other and the print."""
        print_ = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return print_, first, self.other(first, print_)

    def other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * MIX)) & (self.buckets - 1)

    def hits(self, digest: bytes) -> list[int]:
        """References of all slots with the digest's print; empty proves that it is not stored."""
        print_, first, second = self.place(digest)
        return [
            self.refs[slot]
            for bucket in dict.fromkeys((first, second))
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS)
            if self.prints[slot] == print_
        ]

    def insert(self, digest: bytes, ref: int) -> bool:
        print_, first, second = self.place(digest)
        bucket = first
        for kick in range(MAX_KICKS):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.refs[slot] = print_, ref
                    return True
            if kick == 0 and second != first:
                bucket = second
                continue
            slot = bucket * SLOTS + kick % SLOTS
            print_, self.prints[slot] = self.prints[slot], print_
            ref, self.refs[slot] = self.refs[slot], ref
            bucket = self.other(bucket, print_)
        return False

    def delete(self, digest: bytes, ref: int) -> bool:
        print_, first, second = self.place(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == print_ and self.refs[slot] == ref:
                    self.prints[slot], self.refs[slot] = 0, -1
                    return True
        return False


class Shard:
    """Live digests of one shard with the largest id and the size of each group of copies."""

    def __init__(self, buckets: int = 64):
        self.digests: list[bytes | None] = []
        self.keep: list = []
        self.sizes: list[int] = []
        self.filter = CuckooFilter(buckets)
        self.resized = 0

    def find(self, digest: bytes) -> int:
        """Position of a stored digest, or -1. Hits of the filter are verified against whole digests."""
        for ref in self.filter.hits(digest):
            if self.digests[ref] == digest:
                return ref
        return -1

    def add(self, digest: bytes, keep, size: int) -> None:
        ref = self.find(digest)
        if ref < 0:
            self.digests.append(digest)
            self.keep.append(keep)
            self.sizes.append(size)
            if not self.filter.insert(digest, len(self.digests) - 1):
                self.grow()
            return
        self.sizes[ref] += size
        if self.keep[ref] is None or (keep is not None and keep > self.keep[ref]):
            self.keep[ref] = keep

    def remove(self, digest: bytes) -> bool:
        ref = self.find(digest)
        if ref < 0:
            return False
        self.filter.delete(digest, ref)
        self.digests[ref] = None
        return True

    def grow(self) -> None:
        """Twice the buckets, filled from the stored keys; again if these overflow too."""
        buckets = self.filter.buckets
        while True:
            buckets *= 2
            self.resized += 1
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(d, i) for i, d in enumerate(self.digests) if d is not None):
                return

    def load(self, digests: list[bytes], keep: list, sizes: list[int], slots: list[int], buckets: int) -> None:
        """Take a stored shard: every key goes back to the slot it had."""
        self.digests, self.keep, self.sizes = list(digests), list(keep), list(sizes)
        self.filter = CuckooFilter(buckets)
        for ref, (digest, slot) in enumerate(zip(digests, slots)):
            self.filter.prints[slot] = self.filter.place(digest)[0]
            self.filter.refs[slot] = ref

    def slots(self) -> list[int]:
        found = [-1] * len(self.digests)
        for slot, ref in enumerate(self.filter.refs):
            if ref >= 0:
                found[ref] = slot
        return found


@dataclass(frozen=True)
class CuckooIndex:
    """`keys`: shard, digest, keep_id, group_size, slot; `filters`: shard, buckets, prints."""

    keys: DataFrame
    filters: DataFrame
    shards: int


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and SHA-256 of the text with A-Z lower-cased, whole texts, one pass without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        digests = [hashlib.sha256(lower_ascii(text)).digest() for text in utf8(batch.column("text"))]
        return [batch.column("id"), pa.array(digests, pa.binary())]

    return arrow_map(id_and_text(docs, id_col, text_col), f"id {kind}, digest binary", columns, ["id", "digest"])


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def empty_index(spark: SparkSession, shards: int, id_type: str = "bigint") -> CuckooIndex:
    keys = spark.createDataFrame([], f"shard int, digest binary, keep_id {id_type}, group_size bigint, slot int")
    return CuckooIndex(keys, spark.createDataFrame([], "shard int, buckets int, prints binary"), shards)


def _changed(index: CuckooIndex, rows: DataFrame, deleting: bool) -> CuckooIndex:
    """Apply rows (shard, digest, keep_id, group_size) to their shards and store the new index."""
    kind = index.keys.schema["keep_id"].dataType.simpleString()
    schema = f"shard int, digest binary, keep_id {kind}, group_size bigint, slot int, buckets int, prints binary"
    stored = index.keys.join(index.filters.select("shard", "buckets"), "shard")

    def update(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        shard = Shard()
        if old.num_rows:
            columns = old.to_pydict()
            shard.load(columns["digest"], columns["keep_id"], columns["group_size"], columns["slot"],
                       columns["buckets"][0])
        given = new.to_pydict()
        for digest, keep, size in zip(given["digest"], given["keep_id"], given["group_size"]):
            if deleting:
                shard.remove(digest)
            else:
                shard.add(digest, keep, size)
        live = [i for i, digest in enumerate(shard.digests) if digest is not None]
        slots = shard.slots()
        prints = b"".join(p.to_bytes(2, "little") for p in shard.filter.prints)
        number, n = key[0].as_py(), len(live)
        return pa.table({
            "shard": pa.array([number] * (n + 1), pa.int32()),
            "digest": pa.array([shard.digests[i] for i in live] + [None], pa.binary()),
            "keep_id": pa.array([shard.keep[i] for i in live] + [None], new.schema.field("keep_id").type),
            "group_size": pa.array([shard.sizes[i] for i in live] + [0], pa.int64()),
            "slot": pa.array([slots[i] for i in live] + [None], pa.int32()),
            "buckets": pa.array([None] * n + [shard.filter.buckets], pa.int32()),
            "prints": pa.array([None] * n + [prints], pa.binary()),
        })

    both = stored.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(update, schema)
    table = materialize(both, "cuckoo-index")
    return CuckooIndex(
        table.where(F.col("prints").isNull()).select("shard", "digest", "keep_id", "group_size", "slot"),
        table.where(F.col("prints").isNotNull()).select("shard", "buckets", "prints"),
        index.shards,
    )


def insert(index: CuckooIndex, digests: DataFrame) -> CuckooIndex:
    """Add rows (id, digest). Copies are combined per digest and salt before they reach a shard."""
    partial = (
        digests.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        .groupBy("digest", "salt")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(shard_of(F.col("digest"), index.shards).alias("shard"), "digest", "keep_id", "group_size")
    )
    return _changed(index, partial, deleting=False)


def delete(index: CuckooIndex, digests: DataFrame) -> CuckooIndex:
    """Remove live digests (column `digest`) with all their copies; unknown ones are ignored."""
    kind = index.keys.schema["keep_id"].dataType.simpleString()
    rows = digests.select("digest").distinct().select(
        shard_of(F.col("digest"), index.shards).alias("shard"), "digest",
        F.lit(None).cast(kind).alias("keep_id"), F.lit(0).cast("bigint").alias("group_size"),
    )
    return _changed(index, rows, deleting=True)


def lookup(index: CuckooIndex, digests: DataFrame) -> DataFrame:
    """Rows (id, digest) with their stored group: filters first, then the keys for the hits.

    Returns id, digest, keep_id, group_size; the last two are null for digests that are not stored.
    """
    unique = digests.select("digest").distinct()
    sharded = unique.select(shard_of(F.col("digest"), index.shards).alias("shard"), "digest")

    def probe(key: tuple, rows: pa.Table, filters: pa.Table) -> pa.Table:
        known = CuckooFilter(filters.column("buckets")[0].as_py() if filters.num_rows else 1)
        if filters.num_rows:
            data = filters.column("prints")[0].as_py()
            known.prints = [int.from_bytes(data[i:i + 2], "little") for i in range(0, len(data), 2)]
        return pa.table({"digest": [digest for digest in rows.column("digest").to_pylist() if known.hits(digest)]},
                        schema=pa.schema([("digest", pa.binary())]))

    hits = (
        sharded.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInArrow(probe, "digest binary")
    )
    verified = index.keys.join(hits, "digest").select("digest", "keep_id", "group_size")
    return digests.join(verified, "digest", "left").select("id", "digest", "keep_id", "group_size")


def shards_for(digests: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> int:
    return max(1, -(-digests.count() // rows_per_shard))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest, keep_id (largest id of its group of equal texts), group_size, kept."""
    digests = materialize(text_digests(docs, id_col, text_col), "digests")
    kind = digests.schema["id"].dataType.simpleString()
    index = insert(empty_index(docs.sparkSession, shards_for(digests), kind), digests)
    groups = index.keys.select("digest", "keep_id", "group_size")
    return digests.join(groups, "digest").select(
        "id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the documents that are not kept; repeated rows of a kept document become one."""
    winners = (
        exact_duplicates(docs, id_col, text_col).where("kept").groupBy("digest", "id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select(F.col("digest").alias("kept_digest"), F.col("id").alias("kept_id"), "copies")
    )
    winners = materialize(winners, "winners")
    row = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"))
    keyed = row.select("row", *_key(row, id_col, text_col))
    joined = keyed.join(
        winners, (F.col("key_digest") == F.col("kept_digest")) & F.col("key_id").eqNullSafe(F.col("kept_id"))
    )
    single = joined.where("copies = 1").select("row")
    repeated = joined.where("copies > 1").groupBy("key_digest", "key_id").agg(F.first("row").alias("row")).select("row")
    return single.union(repeated).select("row.*")


def _key(row: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Id and digest of a packed row, by built-in functions: the row itself never leaves the JVM."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.translate(F.coalesce(F.col("row")[text_col], F.lit("")), upper, lower)
    return [F.col("row")[id_col].alias("key_id"), F.unhex(F.sha2(text, 256)).alias("key_digest")]
