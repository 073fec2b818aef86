"""Near copies of the pipeline against brute-force Jaccard similarity."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filigree.llm import neardup
from filigree.llm.queries import table


def shingles(text):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i:i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def brute_leaders(rows, least=0.8):
    """Ids that stay of rows (id, text) with ids that differ, and the pairs that are near."""
    sets, holders, parent = [shingles(t) for _, t in rows], {}, list(range(len(rows)))
    for i, own in enumerate(sets):
        for s in own or {None}:
            holders.setdefault(s, []).append(i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    near = [(a, b) for a, b in pairs if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least]
    for a, b in near:
        parent[root(b)] = root(a)
    groups: dict = {}
    for i, (name, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(name)
    return sorted(min(g) for g in groups.values()), len(near)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_stage_equals_brute_force_similarity(spark, sf_dir, size):
    docs = corpus_pipeline.exact_dedup(spark, table(spark, os.path.join(os.path.dirname(sf_dir), size), "documents"), sf_dir)
    want, near = brute_leaders([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == want and near > 1


@pytest.mark.parametrize("part", [neardup.PART, 7])
def test_edited_copies_of_one_text(spark, clashing, part):
    draw = random.Random(4)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = base.copy()
        for _ in range(draw.randrange(9)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    want, _ = brute_leaders(rows)
    got = neardup.drop_similar(clashing(rows), part=part)
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) < 150


def test_odd_rows(spark, clashing):
    rows = [(5, None), (4, ""), (9, " \t\n"), (1, "one"), (2, "ONE"), (2, "ONE"), (None, "alone here"), (3, "a b c d e f"),
            (7, "word " * 300_000), (None, None), (8, "x y z"), (8, "other words"), (11, "É é a b")]
    left = neardup.drop_similar(clashing(rows))
    assert left.columns == clashing(rows).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["4", "1", "None", "3", "7", "8", "8", "11"])
    assert neardup.drop_similar(clashing(rows).where(F.lit(False))).count() == 0
