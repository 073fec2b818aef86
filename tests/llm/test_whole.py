"""Cases at the edge of what the operators on training text must still find."""

from __future__ import annotations

import random

import numpy as np

import pytest
import xxhash

from filigree.llm import decontam, linkrank, text
from filigree.llm.queries import RULES


def test_edited_items_far_apart_in_bits_are_found():
    draw, seen = random.Random(8), 0
    for _ in range(4000):
        words = [f"w{draw.randrange(10**6)}" for _ in range(22)]
        item, edited = " ".join(words).encode(), " ".join([*words[:20], "other", "end"]).encode()
        prints = [decontam.window_prints(decontam.hashes_of(text, 5), np.zeros(1, np.int64), 18)[0] for text in (item, edited)]
        if 16 < int(prints[0] ^ prints[1]).bit_count() <= 23:
            seen += 1
            assert [(m[0], m[1]) for m in decontam.Benchmark([(1, item)]).matches(edited, 0.8)] == [(1, 0.8)]
    assert seen


def test_distrust_reaches_hosts_many_links_away(spark, clashing):
    link = '<a href="http://h{}.org/">x</a>'.format
    pages = [(i, f"http://h{i}.org/", link(i + 1) + (link(40 + i) if i % 3 else "")) for i in range(20)]
    pages += [(20, "http://h20.org/", '<a href="http://bad.net/es/1">x</a>'), (21, "http://bad.net/es/1", None)]
    found = linkrank.judge(clashing(pages, "page_id bigint, url string, html string"), RULES)
    assert {r.id: r.verdict for r in found.collect()} == {i: "block" for i in range(22)}


def test_settled_ranks_equal_the_linear_system(spark):
    links = [("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("x", "b", 1), ("b", "x", 1)]
    edges = spark.createDataFrame(links, "source string, target string, links bigint")
    seeds = spark.createDataFrame([("a", 1, 0), ("c", 0, 1)], "host string, trusted int, blocked int")
    got = {r.host: (r.trust, r.distrust) for r in linkrank.spread(edges, seeds, linkrank.TOLERANCE).collect()}
    hosts = sorted(got)
    for place, seed, pairs in ((0, "a", links), (1, "c", [(b, a, n) for a, b, n in links])):
        given = {h: sum(n for a, _, n in pairs if a == h) for h in hosts}
        matrix = np.eye(len(hosts))
        for a, b, n in pairs:
            matrix[hosts.index(b), hosts.index(a)] -= 0.85 * n / given[a]
        want = np.linalg.solve(matrix, [0.15 * (h == seed) for h in hosts])
        assert [got[h][place] for h in hosts] == pytest.approx(want.tolist(), abs=1e-8)


@pytest.mark.parametrize("block", [1, 5, 20])
def test_blocks_of_few_words_lose_none(block):
    data = b"a " + b"BIG" * 20 + b" c d e"
    words = data.split()
    want = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 1) for i in range(2)]
    assert [h for part in text.shingle_hashes(data, 4, 1, block) for h in part.tolist()] == want
