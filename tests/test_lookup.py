"""Search with spelling mistakes against plain edit distances."""

import random
import re

import pytest
from pyspark.sql import functions as F

from filigree.operators.lookup import deletions, search_many

COMPANIES = "ticker string, name string"
TYPED = "search_id int, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain(companies, typed, k):
    out = []
    for search, text in set(typed):
        text = (text or "").strip(" ").lower()
        found = []
        for ticker, name in set(companies):
            if ticker is None or name is None or not text:
                continue
            label = f"{name} ({ticker})"
            edits = 2 if len(text) >= 8 else 1 if len(text) >= 4 else 0
            near = min((distance(text, w) for w in re.findall(r"[^\W_]+", label.lower())), default=99)
            if text in label.lower():
                found.append((0, 0, label, ticker, name))
            elif near <= edits:
                found.append((1, near, label, ticker, name))
        out += [(search, rank, ticker, name, d) for rank, (_, d, _, ticker, name) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [2, 100])
def test_equals_plain_distances(spark, k):
    draw = random.Random(k)
    names = ["Apple Inc", "Microsoft Corporation", "Maple Leaf", "Alphabet", "Amazon", "Microstrategy", "Ample", "É Société"]
    companies = [("".join(draw.choices("abcd", k=3)).upper(), draw.choice(names)) for _ in range(40)] + [(None, "No ticker"), ("NN", None)]
    typed = [(i, draw.choice(["aple", "appel", "APPLE", "microsfot", "micrsft", "Amazn", "alphabte", "socete", "corporaton", "(ab", "abc", "  maple ", "société", "", None, "zzzzzzzzzz"]))
             for i in range(40)] + [(1, "apple")]
    typed = list({i: (i, t) for i, t in typed}.values())
    got = search_many(spark.createDataFrame(companies, COMPANIES), spark.createDataFrame(typed, TYPED), k)
    assert sorted((r.search_id, r["rank"], r.ticker, r.name, r.distance) for r in got.select("search_id", "rank", "ticker", "name", "distance").collect()) == plain(companies, typed, k)


def test_deletions(spark):
    row = spark.range(1).select(deletions(F.lit("abc"), F.lit(2)).alias("two"), deletions(F.lit("aa"), F.lit(1)).alias("one"),
                                deletions(F.lit(""), F.lit(2)).alias("none"), deletions(F.lit("abc"), F.lit(0)).alias("zero")).first()
    assert sorted(row.two) == ["a", "ab", "abc", "ac", "b", "bc", "c"] and sorted(row.one) == ["a", "aa"]
    assert row.none == [""] and row.zero == ["abc"]


def test_empty_tables(spark):
    companies, typed = spark.createDataFrame([("A", "x")], COMPANIES), spark.createDataFrame([(1, "x")], TYPED)
    assert search_many(companies.limit(0), typed).count() == 0 and search_many(companies, typed.limit(0)).count() == 0
