"""SimHash near-duplicates with BK-trees.

A fingerprint has a bit set if more than half of the hashes of the document's word shingles have it
set. Equal fingerprints are one node. Shards come from the pigeonhole rule: fingerprints of 64 bits
in m blocks that differ in at most r bits agree in at least m - r whole blocks, so every such pair
meets in a shard keyed by some choice of m - r blocks. Each shard is a BK-tree: a child hangs on
the edge that is its Hamming distance to its parent, and a search follows only edges within the radius
of its own distance. A shard of more than a set number of nodes is dealt to several tasks: its tree is
sent to all of them, its queries are divided. Within a shard only a spanning forest of the
links is emitted, never all pairs; components are then joined over all shards.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked
like any other; a null id is never the smallest, and a component of null ids alone has a null
component_id; repeated rows each give a row; an empty table gives an empty result; other columns of
the input are not read. Long texts are hashed a block of words at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType

from filigree.llm.components import connected_components
from filigree.llm.text import arrow_map, id_and_text, lower_ascii, shingle_hashes, utf8
from filigree.session import materialize

BITS = 64
WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints a shard should hold on average; more blocks make more and smaller shards.
SHARD_SIZE = 64
#: Nodes of a shard that one task searches for; a larger shard's queries are divided.
QUERIES = 20_000


def fingerprint(data: bytes, words: int = WORDS) -> int:
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(lower_ascii(data), words, SEED):
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at:at + (1 << 16)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id and fingerprint (64 bits as a bigint) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        found = np.array([fingerprint(text, words) for text in utf8(batch.column("text"))], np.uint64)
        return [batch.column("id"), pa.array(found.view(np.int64))]

    return arrow_map(id_and_text(docs, id_col, text_col), f"id {kind}, fp bigint", columns, ["id", "fp"])


class BKTree:
    """BK-tree over distinct fingerprints; children are keyed by their Hamming distance to the parent."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.children: list[list[tuple[int, int]]] = [[] for _ in fps]
        pending = [np.arange(len(fps))] if len(fps) else []
        while pending:
            below = pending.pop()
            node, rest = int(below[0]), below[1:]
            distance = np.bitwise_count(fps[rest] ^ fps[node])
            for edge in np.unique(distance).tolist():
                child = rest[distance == edge]
                self.children[node].append((edge, int(child[0])))
                pending.append(child)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """A node and the positions of the queries within the radius of it, for all nodes that have any."""
        pending = [(0, np.arange(len(queries)))] if len(self.fps) else []
        while pending:
            node, asked = pending.pop()
            distance = np.bitwise_count(queries[asked] ^ self.fps[node]).astype(np.int16)
            near = asked[distance <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node]:
                within = asked[np.abs(distance - edge) <= radius]
                if len(within):
                    pending.append((child, within))


class Forest:
    """Union-find over positions, vectorised for one node against many."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        found = self.parent[nodes]
        while True:
            up = self.parent[found]
            if (up == found).all():
                self.parent[nodes] = found
                return found
            found = up

    def join(self, nodes: np.ndarray) -> None:
        roots = np.unique(self.roots(nodes))
        self.parent[roots] = roots[0]


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of every choice of blocks - radius blocks, as signed 64-bit integers."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(choice) for choice in combinations(single, blocks - radius)]
    return [mask - (1 << BITS) if mask >> (BITS - 1) else mask for mask in masks]


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks at which random fingerprints give shards of the wanted size."""
    blocks = radius + 1
    while blocks < 2 * radius and n / 2 ** (BITS * (blocks - radius) / blocks) > SHARD_SIZE:
        blocks += 1
    return blocks


def _sharded(nodes: DataFrame, radius: int, n: int, queries: int) -> DataFrame:
    """Rows (mask, key, part, fp, own): the members of each shard, and in which part each is a query."""
    masks = block_masks(blocks_for(n, radius), radius)
    choices = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]
    members = nodes.select("fp", F.explode(F.array(*choices)).alias("s")).select("s.mask", "s.key", "fp")
    sizes = members.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / queries).cast("int")
    return (
        members.join(sizes, ["mask", "key"]).withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("mask", "key", "part", "fp", (F.pmod(F.xxhash64("fp"), "parts") == F.col("part")).alias("own"))
    )


def _shard_links(columns: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one shard to the root of each member's tree in the spanning forest."""
    fps, own = columns
    tree, forest = BKTree(fps), Forest(len(fps))
    asked = np.flatnonzero(own)
    for node, near in tree.search(fps[asked], radius):
        if len(near) > 1 or asked[near[0]] != node:
            forest.join(np.append(asked[near], node))
    everyone = np.arange(len(fps))
    roots = forest.roots(everyone)
    moved = roots != everyone
    return fps[moved], fps[roots[moved]]


def near_links(nodes: DataFrame, radius: int = RADIUS, queries: int = QUERIES) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all those within the radius."""
    n = nodes.count()
    shards = _sharded(nodes, radius, n, queries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        held_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("mask", "key", "part")])
            values = [batch.column("fp").to_numpy().view(np.uint64), batch.column("own").to_numpy(zero_copy_only=False)]
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            found = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                key, part = tuple(keys[:, a].tolist()), [v[a:b] for v in values]
                if held_key == key:
                    held = [np.concatenate(pair) for pair in zip(held, part)]
                    continue
                if held is not None:
                    found.append(_shard_links(held, radius))
                held_key, held = key, part
            if found:
                yield _link_batch(found)
        if held is not None:
            yield _link_batch([_shard_links(held, radius)])

    keys = ["mask", "key", "part"]
    return shards.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def _link_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sides = [np.concatenate(side).view(np.int64) for side in zip(*found)]
    return pa.RecordBatch.from_arrays([pa.array(side) for side in sides], ["a", "b"])


def near_groups(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int) -> DataFrame:
    """One row per document: id, fp, root (the fingerprint that stands for its component), component_id."""
    found = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = materialize(found.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    members = connected_components(near_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(members, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = rooted.join(roots, "root").select("fp", "root", "component_id")
    return found.join(placed, "fp").select("id", "fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """One row per document: id, fp, component_id (smallest id among all that links reach)."""
    return near_groups(docs, id_col, text_col, words, radius).select("id", "fp", "component_id")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """`docs` with one document of every component: the one of the smallest id.

    Where several rows share that id, or it is null, the one with the smallest fingerprint stays; of rows equal in
    both, any one.
    """
    marked = materialize(near_groups(docs, id_col, text_col, words, radius), "near-groups")

    def signed(text: bytes) -> int:
        found = fingerprint(text, words)
        return found - (1 << BITS) if found >> (BITS - 1) else found

    return keep_leaders(docs, marked, id_col, text_col, signed, LongType())


def keep_leaders(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, print_of: Callable, kind: DataType) -> DataFrame:
    """`docs` with one row of every root of `marked` (id, fp, root, component_id); `print_of` gives the fp of a text."""
    leaders = marked.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.first("id").alias("id"), F.min("fp").alias("fp"))
    repeated = marked.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or id is null").select(F.col("id").alias("other"))
    leaders = leaders.join(repeated, F.col("id").eqNullSafe(F.col("other")), "left")
    leaders = leaders.withColumn("clear", F.col("other").isNull() & F.col("id").isNotNull()).select("id", "fp", "clear")
    leaders = materialize(leaders, "leaders")
    row = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"))
    keyed = row.withColumn("key", F.col("row")[id_col])
    clear = leaders.where("clear").select(F.col("id").alias("key"))
    left = keyed.join(clear, "key", "left_semi").select("row")
    shared = leaders.where("not clear").select(F.col("id").alias("leader"), F.col("fp").alias("leader_fp"))
    if shared.take(1):
        ids = shared.select("leader").distinct()
        asked = keyed.join(ids, F.col("key").eqNullSafe(F.col("leader")), "left_semi").select("row", "key", F.col("row")[text_col].alias("text"))
        printed = _with_prints(asked, print_of, kind)
        chosen = printed.join(shared, F.col("key").eqNullSafe(F.col("leader")) & (F.col("fp") == F.col("leader_fp")), "left_semi")
        left = left.union(chosen.groupBy("key", "fp").agg(F.first("row").alias("row")).select("row"))
    return left.select("row.*")


def _with_prints(rows: DataFrame, print_of: Callable, kind: DataType) -> DataFrame:
    """Rows (row, key, text) with their fingerprint in place of the text."""
    schema = rows.select("row", "key").schema.add("fp", kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = pa.array([print_of(text) for text in utf8(batch.column(2))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["row", "key", "fp"])

    return rows.mapInArrow(run, schema)
