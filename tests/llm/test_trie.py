"""The conversation trie against a trie of plain dictionaries, and against its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filigree.llm import trie
from filigree.llm.queries import op11_prefix_trie, table

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    """Nodes by brute force: every rebuilt conversation is a member of each of its prefixes."""
    turns: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turn_text = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            turns.setdefault(conv, []).append(
                ((turn is not None, turn or 0), hashlib.sha256(turn_text.encode()).hexdigest(), (role or "", text or "")))
    own = {c: [t[2] for t in sorted(found)] for c, found in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(own[c] if base == c else [*own.get(base, [])[:h], *own[c][h:]])
    nodes: dict = {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            nodes.setdefault(whole[c][:d], []).append(c)
    children, below = {}, {}
    for key in nodes:
        if key:
            children[key[:-1]] = children.get(key[:-1], 0) + 1
    for key, members in nodes.items():
        saved = (len(members) - 1) * len(key[-1][1].encode()) if key else 0
        for d in range(len(key) + 1):
            leaves, total = below.get(key[:d], (0, 0))
            below[key[:d]] = leaves + (key not in children), total + saved
    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in members if whole[c] == key)
        out.append((members[0], len(key), nodes[key[:-1]][0] if key else None, len(members), children.get(key, 0), *below[key],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def found_rows(frame):
    assert sorted(frame.columns) == sorted(NAMES)
    return sorted(repr(tuple(r)) for r in frame.select(NAMES).collect())


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found_rows(op11_prefix_trie(spark, sf_dir)) == plain_trie(rows)


ODD = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "ho"), (0, None, None, None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, 5, "user", "é" * 9),
    (3, 1, "a", "bc"), (3, 2, "ab", "c"), (4, 1, "ab", "c"), (None, 0, "user", "nobody"), (-4, 0, "user", "hi"), (-7, 0, "x", ""), (-5, 0, "x", None),
    (-5, 1, "x", "y"), (10, 3, "user", "z" * 300_000), (11, 3, "user", "z" * 300_000), (12, 3, None, "z"), (8, 0, "lone", "base absent"),
    (9, 2**40, "lone", "base absent"),
]


@pytest.mark.parametrize("band", [2, trie.BAND])
def test_odd_rows(spark, clashing, band):
    draw = random.Random(3)
    long_ones = [(c, i, "user", f"t{i % 7}") for c in (20, 21, 25, 26) for i in range(70 + 90 * (c % 5))]
    many = [(c, i, "user", draw.choice("ab")) for c in range(100, 220) for i in range(draw.randrange(7))]
    rows = ODD + long_ones + many
    frame = clashing(rows, SCHEMA)
    assert found_rows(trie.prefix_trie(trie.rebuilt(frame), band)) == plain_trie(rows)
    con = duckdb.connect()
    con.register("conversations", pa.table({n: [r[i] for r in rows] for i, n in enumerate(("conv_id", "turn", "role", "text"))}))
    names = ", ".join(NAMES)
    assert sorted(repr(tuple(r)) for r in con.sql(trie.oracle_sql()).select(names).fetchall()) == plain_trie(rows)


def test_one_conversation_holds_a_third_of_all_rows(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = [(3, i, "user", str(i % 11)) for i in range(400)] + [(c, i, "user", str(i)) for c in range(40, 240) for i in range(4)]
        frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert found_rows(trie.prefix_trie(trie.rebuilt(frame))) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_tables_without_conversations(spark, clashing):
    frame = clashing(ODD, SCHEMA)
    assert trie.prefix_trie(trie.rebuilt(frame.where(F.lit(False)))).count() == 0
    assert trie.prefix_trie(trie.rebuilt(frame.where("conv_id is null"))).count() == 0


def test_a_node_meets_a_band_of_others_at_most(spark):
    rows = [(5 * c, i, "user", f"{i if i < 50 else (i, c)}") for c in range(3) for i in range(100)]
    paths = trie.prefixes(trie.rebuilt(spark.createDataFrame(rows, SCHEMA)))
    sizes = [r.n for step in (1, 8, 64) for r in trie.band_paths(paths, step, 8).select(F.size("up").alias("n")).collect()]
    assert max(sizes) == 9  # eight nodes above the root of a band, and the root itself
