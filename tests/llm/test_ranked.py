"""Ranked search against plain scoring of every document, and against its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filigree.llm import ranked
from filigree.llm.queries import op12_ranked_search, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(A_TO_Z))


def plain_search(docs, items, k=20):
    counts = [Counter(terms_of(t)) for _, t in docs]
    lengths = [sum(c.values()) for c in counts]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for (doc, _), c, n in zip(docs, counts, lengths):
            if n:
                m = 100 - 25 + 25 * n * n_docs // total
                score = sum(q * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in terms.items() if t in c)
                if score > 0:
                    scores.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(repr, out))


def found_rows(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    assert found_rows(op12_ranked_search(spark, sf_dir)) == plain_search(docs, items)


ITEMS = [(1, "The quick brown fox"), (2, None), (3, ""), (4, "... !!"), (5, "the the the É"), (5, "zebra"), (None, "éa fox_trot x1"), (6, "nowhere at all")]


@pytest.mark.parametrize("run_docs", [3, ranked.RUN_DOCS])
def test_odd_rows(spark, clashing, run_docs):
    draw = random.Random(1)
    words = ["the", "THE", "quick", "brown", "fox", "é", "É", "éa", "x1", "zebra", "trot", "日本"]
    docs = [(i, " ".join(draw.choices(words, range(12, 0, -1), k=draw.randrange(40)))) for i in range(300)]
    docs += [(7, "fox"), (7, "fox"), (None, "fox"), (None, None), (301, ""), (302, "--"), (303, "fox " * 400_000), (304, "a" * 3_000_000 + " zebra"), (305, "x\x001\x7fx1")]
    docs += [(1000 + i, "brown fox") for i in range(60)]
    items = spark.createDataFrame([(*r, "x", 1) for r in ITEMS], "item_id bigint, text string, terms string, n int")
    got = found_rows(ranked.nra_search(clashing(docs), items, run_docs=run_docs))
    assert got == plain_search(docs, ITEMS)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs]}))
    con.register("benchmark", pa.table({"item_id": [d[0] for d in ITEMS], "text": [d[1] for d in ITEMS]}))
    assert sorted(repr(tuple(r)) for r in con.sql(ranked.oracle_sql()).fetchall()) == got
    assert found_rows(ranked.nra_search(clashing(docs), items, k=3)) == plain_search(docs, ITEMS, 3)


def test_empty_tables(spark, clashing):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = clashing([(1, "fox"), (2, None)])
    assert ranked.nra_search(docs.where(F.lit(False)), items).count() == 0
    assert ranked.nra_search(docs, items.where(F.lit(False))).count() == 0
    assert ranked.nra_search(docs.where("doc_id = 2"), items).count() == 0


def test_lists_are_read_from_the_front_only_as_far_as_needed():
    """Two lists of 10,000 whose best documents are far ahead: the reading ends early, with whole scores."""
    draw = np.random.default_rng(5)
    n = 10_000
    docs = np.tile(np.arange(n), 2)
    shares = draw.integers(1, 1000, 2 * n)
    shares[[17, n + 17, 4000, n + 4000]] = [90_000, 80_000, 70_000, 60_000]
    lists = ranked.Lists(docs, np.repeat([0, 1], n), shares, 2, n)
    reads = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(len(range(*key.indices(len(self)))))
            return np.asarray(super().__getitem__(key))

    lists.shares = lists.shares.view(Counting)
    found, scores = lists.best(np.array([0, 1]), np.array([1, 2]), 2)
    assert dict(zip(found.tolist(), scores.tolist())) == {17: 250_000, 4000: 190_000}
    assert sum(reads) < 1000
