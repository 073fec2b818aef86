"""Dictionary tables against plain substring tests."""

import random

import pytest

from filigree.operators import dictionary
from filigree.operators.dictionary import keyed_words as plain_keyed
from filigree.operators.dictionary import match_dictionary

TEXTS = "doc_id bigint, text string"
WORDS = "rule string, word string"


def plain(texts, words):
    return sorted({(str(i), r) for i, t in texts for r, w in words if t is not None and w and w.strip() and w.lower() in t.lower()}, key=str)


def found(spark, texts, words):
    rows = match_dictionary(spark.createDataFrame(texts, TEXTS).repartition(3), spark.createDataFrame(words, WORDS)).collect()
    return sorted([(str(r.doc_id), r.rule) for r in rows], key=str)


@pytest.mark.parametrize("n", [5, 400])
def test_equals_plain_tests(spark, n):
    draw = random.Random(n)
    letters = "abcé \U0001f600"
    texts = [(i, "".join(draw.choices(letters, k=draw.randrange(60)))) for i in range(80)]
    words = [(f"r{draw.randrange(30)}", "".join(draw.choices(letters, k=draw.randint(1, 6)))) for _ in range(n)]
    assert found(spark, texts, words) == plain(texts, words)


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "Ab"), (3, "xyz cash FLOW"), (4, "CASH flow\nmore"), (None, "zz top"), (5, "word " * 100_000 + "needle")]
    words = [("short", "a"), ("short", "zz"), ("flow", "cash flow"), ("none", None), ("none", " "), ("none", ""), ("far", "NEEDLE"), ("flow", "cash flow"), (None, "top")]
    assert found(spark, texts, words) == plain(texts, words)
    assert found(spark, texts, words[3:6]) == [] and found(spark, texts[:0] or [(1, None)], words) == []


def test_many_keywords_from_a_table(spark):
    """100,000 keywords: the plan has no expression for any of them."""
    words = [(f"r{i % 100}", f"k{i:06d}x") for i in range(100_000)]
    texts = [(i, f"aa k{i * 37:06d}x bb k{i:06d}") for i in range(300)]
    frame = match_dictionary(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(words, WORDS))
    assert sorted((r.doc_id, r.rule) for r in frame.collect()) == sorted((i, f"r{i * 37 % 100}") for i in range(300))
    assert len(frame._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_words_that_add_nothing_are_not_tested(spark, monkeypatch):
    """Short words are found by the join alone, and longer ones that hold one of their rule are left out."""
    tested = []
    monkeypatch.setattr(dictionary, "keyed_words", lambda words, held: tested.append({r.word for r in words.collect()}) or plain_keyed(words, held))
    texts = [(1, "xaby \U0001f600?c"), (2, "abz"), (3, "cab q\x00r \ufffdz"), (None, "lab?"), (4, "?z?")]
    words = [("r", "ab"), ("r", "cab q"), ("r", "xaby"), ("s", "xaby"), ("s", "?c"), ("s", "\U0001f600"), ("t", "\x00r"), ("t", "r"), ("t", "\ufffdz"), (None, "b?"), (None, "lab?")]
    assert found(spark, texts, words) == plain(texts, words)
    assert tested == [{"xaby", "\ufffdz"}]
