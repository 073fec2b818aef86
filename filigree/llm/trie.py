"""Prefix trie of conversations with subtree totals, rolled up in bands of depth.

A node of depth d is a distinct sequence of the first d turns (role, text). Its key is 128 bits: the exclusive or of
one hash for each place and the turn there, so a running window gives the keys of all prefixes.

Depth-band rollup: a node is exploded to its ancestors inside its band of `BAND` depths only, itself included. That
completes the totals of the band's root over the band. Roots of bands are then the nodes of the next level, where a
band is `BAND` times as high, and so on until one band holds all. On the way back the completed total of a
band's root is added to the at most `BAND` nodes above it in the band before. A trie of depth D so takes about
2 * log(D) / log(BAND) rounds, and no node is ever exploded to more than `BAND` others.

A conversation of any length is ranked by a sort over ranges of (conversation, turn); what a range begins with
is continued from the ranges before by a table of at most one row a range. Ids that end at one node reach their digest
as sorted runs of bounded size, since the digest itself can only be taken in order.

Defined results: rows without conv_id belong to no conversation and are left out; a null turn comes first, turns of
equal number follow each other by the SHA-256 of role and text; null role and text count as empty; repeated
rows are turns of their own; a table without a conversation gives no node, not even a root; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.session import materialize

#: Depths of a band; also the most nodes that one node is exploded to.
BAND = 8
#: Depths over which one running window goes.
CHUNK = 64
#: Bytes of a run of ids on the way to their digest.
RUN_BYTES = 1 << 16


def ranked(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest of role and text, and bytes of the text, for every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.unhex(F.substring(F.sha2(turn, 256), 1, 32)).alias("digest"), F.octet_length(text).alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id").to_numpy()
            first = np.concatenate(([True], conv[1:] != conv[:-1]))
            at = np.arange(n)
            place = at - np.maximum.accumulate(np.where(first, at, 0))
            if last == conv[0]:
                place[:int(np.argmax(first[1:])) + 1 if first[1:].any() else n] += seen
            last, seen = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(np.full(n, part, np.int32)), pa.array(place), batch.column("digest"), batch.column("bytes")],
                ["conv_id", "part", "place", "digest", "bytes"])

    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(placed.mapInArrow(number, "conv_id bigint, part int, place bigint, digest binary, bytes int"), "turns")


def rebuilt(conversations: DataFrame, group: int = 5, shared: int = 9) -> DataFrame:
    """The turns of every rebuilt conversation: conv_id, depth (from 1; 0 is a row without a turn), digest, bytes, n (turns).

    A conversation c begins with the first h turns of conversation c - c % `group`, h = crc32(c) % `shared`; its
    own turns after its first h follow.
    """
    placed = ranked(conversations)
    runs = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))), "runs")
    # Only the conversation a range begins with can have turns before it, so this has at most one row a range.
    continued = F.broadcast(runs.where("before > 0").select("conv_id", "part", "before"))
    turns = placed.join(continued, ["conv_id", "part"], "left").withColumn("pos", F.col("place") + F.coalesce("before", F.lit(0)))

    own = F.col("conv_id") % group == 0
    taken = F.when(own, 0).otherwise(F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    heads = (
        turns.where(own & (F.col("pos") < shared - 1)).groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))
    )
    convs = runs.groupBy("conv_id").agg(F.sum("rows").alias("own")).withColumn("h", taken)
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    layout = convs.join(heads, "base", "left").withColumn("head", F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.greatest("h", F.lit(1)))))
    m = F.when(F.col("head").isNull(), 0).otherwise(F.size("head"))
    layout = layout.select(
        "conv_id", "head", (m - F.col("h")).alias("shift"), (m + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    layout = materialize(layout, "layout")
    nothing = [F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("bytes"), "n"]
    copied = layout.select("conv_id", "n", F.explode("head").alias("t")).select(
        "conv_id", (F.col("t.pos") + 1).alias("depth"), "t.digest", "t.bytes", "n")
    rest = turns.where(F.col("pos") >= taken).join(layout.select("conv_id", "shift", "n"), "conv_id").select(
        "conv_id", (F.col("pos") + 1 + F.col("shift")).alias("depth"), "digest", "bytes", "n")
    return layout.select("conv_id", *nothing).union(copied).union(rest)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key (x, y) and parent's key (px, py) of every prefix, bytes of its last text, and whether it is the whole.

    `turns`: rows as `rebuilt` gives them, the row of depth 0 of every conversation included.
    """
    def mixed(seed: int) -> Column:
        return F.when(F.col("depth") == 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.lit(seed), "depth", "digest"))

    along = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.select("conv_id", "depth", "bytes", (F.col("depth") == F.col("n")).alias("whole"),
                        mixed(1).alias("a"), mixed(2).alias("b"), F.floor(F.col("depth") / CHUNK).alias("chunk"))
    rows = rows.withColumn("x", F.bit_xor("a").over(along)).withColumn("y", F.bit_xor("b").over(along))
    rows = materialize(rows, "chunks")
    # A conversation of more than CHUNK turns is carried from chunk to chunk: one row for each whole chunk.
    to_here = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.where(F.col("depth") % CHUNK == CHUNK - 1).select("conv_id", (F.col("chunk") + 1).alias("chunk"), "x", "y")
    carried = materialize(ends.select(
        "conv_id", "chunk", F.bit_xor("x").over(to_here).alias("cx"), F.bit_xor("y").over(to_here).alias("cy")), "carried")
    rows = rows.join(carried, ["conv_id", "chunk"], "left")
    x, y = (F.col(v).bitwiseXOR(F.coalesce(F.col("c" + v), F.lit(0))) for v in "xy")
    return materialize(rows.select(
        "conv_id", "depth", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("a")).alias("px"), y.bitwiseXOR(F.col("b")).alias("py"),
        "bytes", "whole"), "prefixes")


def band_paths(paths: DataFrame, step: int, band: int) -> DataFrame:
    """Nodes of depths divisible by `step` with the keys above them: (x, y, below, up).

    `up` goes from the root of the node's own band (`band` steps high) to the node. The root of every band but the first
    is given again with the path through the band before it (`below` true).
    """
    height = band * step
    own = F.floor(F.col("depth") / height)
    root = (F.col("depth") % height == 0) & (F.col("depth") > 0)
    rows = paths.where(F.col("depth") % step == 0).select("conv_id", "depth", "x", "y", F.explode(
        F.when(root, F.array(own, own - 1)).otherwise(F.array(own))).alias("band"))
    down = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("x", "y", (own != F.col("band")).alias("below"), F.collect_list(F.struct("x", "y")).over(down).alias("up"))
    return materialize(rows.groupBy("x", "y", "below").agg(F.first("up").alias("up")), "bands")


def _spread(nodes: DataFrame, above: Column) -> DataFrame:
    """Totals of (leaves, saved) at the keys of `above`."""
    return (
        nodes.select(F.explode(above).alias("to"), "leaves", "saved")
        .groupBy(F.col("to.x").alias("x"), F.col("to.y").alias("y")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    )


def rollup(values: DataFrame, paths: DataFrame, band: int = BAND) -> DataFrame:
    """Sums of `leaves` and `saved` of `values` (x, y, leaves, saved) over the subtree of every node."""
    deepest = paths.agg(F.max("depth")).first()[0] or 0
    bands, inside, step = [], [], 1
    while True:
        bands.append(band_paths(paths, step, band))
        own = bands[-1].where("not below").join(values, ["x", "y"])
        inside.append(materialize(_spread(own, F.col("up")), "inside"))
        values, step = inside[-1], step * band
        if step > deepest:
            break
    done = inside.pop()
    for level in reversed(range(len(inside))):
        roots = bands[level].where("below").join(done, ["x", "y"])
        handed = _spread(roots, F.slice("up", F.lit(1), F.size("up") - 1))
        done = inside[level].union(handed).groupBy("x", "y").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        done = materialize(done, "totals")
    return done


def end_digests(ends: DataFrame) -> DataFrame:
    """x, y and the SHA-256 of the ascending, comma-joined conv_ids of each key."""
    order = ["x", "y", "conv_id"]

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, conv = (batch.column(c).to_numpy() for c in order)
            new = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            step = RUN_BYTES // 20
            cuts = [a for start, end in zip([0, *new.tolist()], [*new.tolist(), len(conv)]) for a in range(start, end, step)]
            pieces = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(conv)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[cuts]), pa.array(y[cuts]), pa.array(conv[cuts]), pa.array(pieces, pa.string())], ["x", "y", "conv_id", "ids"])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            found = []
            for *place, ids in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "ids"))):
                if place != key:
                    if key is not None:
                        found.append((*key, state.hexdigest()))
                    key, state = place, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield from rows_of(found)
        if key is not None:
            yield from rows_of([(*key, state.hexdigest())])

    def rows_of(found: list) -> Iterator[pa.RecordBatch]:
        if found:
            x, y, text = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(text, pa.string())], ["x", "y", "ends_sha256"])

    sorted_ends = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    held = sorted_ends.mapInArrow(runs, "x bigint, y bigint, conv_id bigint, ids string")
    return held.repartition("x", "y").sortWithinPartitions(*order).mapInArrow(digest, "x bigint, y bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node of the trie over rows as `rebuilt` gives them: conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = prefixes(turns)
    nodes = materialize(paths.groupBy("x", "y").agg(
        F.max("depth").alias("depth"), F.max("px").alias("px"), F.max("py").alias("py"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("whole").cast("bigint")).alias("ends"), F.max("bytes").alias("bytes")), "trie")
    # A node is childless when all its members end there.
    values = nodes.select(
        "x", "y", (F.col("n_convs") == F.col("ends")).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals = rollup(values, paths, band)
    children = nodes.where("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent"))
    found = (
        nodes.join(totals, ["x", "y"]).join(children, ["x", "y"], "left")
        .join(end_digests(paths.where("whole")), ["x", "y"], "left").join(parents, ["px", "py"], "left")
    )
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def oracle_sql() -> str:
    """The query over the given table in SQL, every node exploded to all its ancestors."""
    return """
        with t as (
            select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
                   row_number() over (partition by conv_id order by turn nulls first,
                       sha256(cast(strlen(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
            from conversations where conv_id is not null),
        crc as (
            select c, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda d: ascii(d)::bigint)),
                       lambda v, d: list_reduce([xor(v, d), 0, 0, 0, 0, 0, 0, 0, 0],
                           lambda w, z: xor(w >> 1, 3988292384::bigint * (w & 1)))) as v
            from (select distinct c from t)),
        convs as (select c, case when c % 5 = 0 then 0 else xor(v, 4294967295::bigint) % 9 end as h from crc),
        turns as (
            select v.c, t.pos as place, 0 as own, t.role, t.text from convs v join t on t.c = v.c - v.c % 5 and t.pos <= v.h
            union all
            select v.c, t.pos, 1, t.role, t.text from convs v join t on t.c = v.c and t.pos > v.h),
        r as (
            select c, row_number() over (partition by c order by own, place) as depth, strlen(text) as bytes,
                   sha256(cast(strlen(role) as varchar) || ':' || role || text) as s
            from turns),
        p as (
            select c, depth, bytes, string_agg(s, '') over (partition by c order by depth) as key from r
            union all select c, 0, 0, '' from convs),
        size as (select c, max(depth) as n from p group by c),
        m as (
            select key, depth, min(p.c) as conv_id, count(*) as n_convs, count(*) filter (where depth = n) as ends, max(bytes) as bytes,
                   sha256(coalesce(string_agg(p.c::varchar, ',' order by p.c) filter (where depth = n), '')) as ends_sha256
            from p join size using (c) group by key, depth),
        up as (select unnest(range(depth + 1)) as d, key, n_convs, ends, bytes from m),
        totals as (
            select left(key, d * 64) as key, sum((n_convs = ends)::bigint)::bigint as n_leaves, sum((n_convs - 1) * bytes)::bigint as saved_tokens
            from up group by 1),
        children as (select left(key, (depth - 1) * 64) as key, count(*) as n_children from m where depth > 0 group by 1)
        select m.conv_id, m.depth::bigint as depth, a.conv_id as parent_conv_id, m.n_convs, coalesce(n_children, 0) as n_children,
               n_leaves, saved_tokens, m.ends_sha256
        from m join totals using (key) left join children using (key)
        left join m a on m.depth > 0 and a.key = left(m.key, (m.depth - 1) * 64)"""
