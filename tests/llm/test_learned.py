"""SimHash, decontamination, learned models and the pipeline against brute force or held-out labels."""

from __future__ import annotations

import hashlib
import os
import sys
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from filigree.llm import components, decontam, langid, quality, simhash
from filigree.llm.queries import held_out, op1_simhash_near_dedup, op4_language_id, op5_quality, op9_decontamination, table

from .test_neardup import brute_leaders


def plain_print(text, words=4):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, radius=4):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups: dict = {}
    for i in range(len(prints)):
        groups.setdefault(root(i), []).append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(prints))]


def test_components_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    prints = [plain_print(d.text) for d in docs]
    best = plain_components(prints, [d.doc_id for d in docs])
    want = sorted((d.doc_id, f"{p:016x}", c) for d, p, c in zip(docs, prints, best))
    assert sorted(map(tuple, op1_simhash_near_dedup(spark, sf_dir).collect())) == want


def test_odd_documents(spark, clashing):
    rows = [(5, None), (4, ""), (9, " \t\n"), (1, "one"), (2, "ONE"), (2, "ONE"), (None, "alone here"), (3, "a b c d e f"),
            (7, "word " * 300_000), (None, None), (8, "x y z"), (11, "É é a b")]
    found = simhash.near_duplicates(clashing(rows)).collect()
    prints = [plain_print(t) if t is None or len(t) < 100 else plain_print("word word word word") for _, t in rows]
    best = plain_components(prints, [i for i, _ in rows])
    got = sorted((str(r.id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in found)
    assert got == sorted((str(i), p, str(c)) for (i, _), p, c in zip(rows, prints, best))
    left = simhash.drop_near_duplicates(clashing(rows))
    assert left.columns == clashing(rows).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["4", "1", "None", "3", "7", "8", "11"])
    assert simhash.near_duplicates(clashing(rows).limit(0)).count() == 0


@pytest.mark.parametrize("queries", [20_000, 7])
def test_links_connect_all_within_the_radius(spark, queries):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = set(rng.integers(0, 1 << 63, 300, dtype=np.uint64).tolist())
    for centre in centres.tolist():
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 9), replace=False)
            prints.add(centre ^ sum(1 << int(b) for b in flips))
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    roots = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in components.connected_components(simhash.near_links(nodes, 4, queries)).collect()}
    want = plain_components(prints, list(range(len(prints))))
    by_root: dict = {}
    for p, c in zip(prints, want):
        by_root.setdefault(c, set()).add(roots.get(p, p))
    assert all(len(r) == 1 for r in by_root.values()) and len(by_root) == len(set.union(*by_root.values()))


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_every_choice_of_blocks_finds_every_pair(blocks):
    masks = [m & (1 << 64) - 1 for m in simhash.block_masks(blocks, 4)]
    rng = np.random.default_rng(blocks)
    for _ in range(300):
        change = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not change & mask for mask in masks)


def test_tree_search_equals_a_scan():
    rng = np.random.default_rng(5)
    prints = np.unique(rng.integers(0, 1 << 14, 900).astype(np.uint64))
    tree = simhash.BKTree(prints)
    got = {(node, int(q)) for node, near in tree.search(prints, 2) for q in near}
    distance = np.bitwise_count(prints[:, None] ^ prints[None, :])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(distance <= 2))}


def test_long_chains_end_in_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.connected_components(edges.union(spark.range(1).select(F.lit(900).alias("a"), F.lit(901).alias("b"))))
    assert {r.node: r.root for r in found.collect()} == {**{i: 0 for i in range(1, 301)}, 901: 900}


def brute_contamination(text, items, least=0.8):
    plain = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "")).encode().lower().split()
    out = set()
    for item, body in items:
        words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (body or "")).encode().lower().split()
        k = min(5, len(words))
        if not words or len(plain) < k:
            continue
        own = Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
        shingles = [tuple(plain[i:i + k]) for i in range(len(plain) - k + 1)]
        n = min(own.total(), len(shingles))
        for start in range(len(shingles) - n + 1):
            window = Counter(shingles[start:start + n])
            shared = (own & window).total()
            if shared / (own.total() + n - shared) >= least:
                out.add(item)
                break
    return out


def test_contamination_equals_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    want = {(d.doc_id, i) for d in docs for i in brute_contamination(d.text, items)}
    got = op9_decontamination(spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 0
    assert all(0.8 <= r.similarity <= 1 for r in got)


def test_odd_items_and_documents(spark, clashing, monkeypatch):
    body = "the quick brown fox jumps over the lazy dog while seven wizards watch from a tower of old red stone and sing"
    items = [(1, body), (2, None), (3, ""), (4, "alpha beta"), (5, body.replace("wizards", "witches")), (6, "..."), (1, body)]
    docs = [(1, "Start. " + body.upper() + "! end of it"), (2, body.replace("lazy", "idle")), (3, None), (4, ""), (5, "so alpha, beta"),
            (6, body[:60]), (7, ("filler words go here " * 20_000) + body), (None, body), (8, "beta alpha"), (8, body.replace(" ", "\n"))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((str(i), j) for i, t in docs if t is None or len(t) < 1000 for j in brute_contamination(t, items)) + [("7", 1)]
    for block in (10_000, 2):
        monkeypatch.setattr(decontam, "ITEMS", block)
        got = decontam.contamination(clashing(docs), bench).select("id", "item").distinct().collect()
        assert sorted({(str(r.id), r.item) for r in got}) == sorted(set(want))
        kept = decontam.drop_contaminated(clashing(docs), bench)
        clean = sorted(str(i) for i, t in docs if i != 7 and not brute_contamination(t, items))
        assert sorted(str(r.doc_id) for r in kept.collect()) == clean
    assert decontam.contamination(clashing(docs), bench.limit(0)).count() == 0
    assert decontam.contamination(clashing(docs).limit(0), bench).count() == 0


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    index = decontam.HammingIndex(prints)
    for _ in range(200):
        base = int(prints[rng.integers(200)]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 20), replace=False))
        want = np.flatnonzero(np.bitwise_count(prints ^ np.uint64(base)) <= decontam.RADIUS)
        assert index.search(base).tolist() == want.tolist()


@pytest.fixture(scope="module")
def larger(sf_dir):
    """Enough labelled rows to judge a model by."""
    return os.path.join(os.path.dirname(sf_dir), "sf0.01")


def test_languages_of_held_out_documents(spark, larger):
    docs = table(spark, larger, "documents")
    rows = op4_language_id(spark, larger).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and held
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts_have_no_language(spark, clashing, sf_dir):
    model = langid.train(table(spark, sf_dir, "documents"))
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the house and the"), (None, "der und die"), (5, "日本"), (6, "é" * 3_000_000)]
    got = {r.id: (r.lang_pred, r.score) for r in langid.predict(clashing(rows), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model.languages and got[5][0] in model.languages
    kept = langid.keep_identified(clashing(rows), model, 0.0)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "6", "None"]
    nothing = langid.train(table(spark, sf_dir, "documents").limit(0))
    assert {r.lang_pred for r in langid.predict(clashing(rows), nothing).collect()} == {"und"}
    assert 0.2 < (model.table == 0).mean() < 1


def test_letters_are_those_of_the_language():
    """Numbers of every kind are no letters, on any code point."""
    for at in range(0, sys.maxunicode + 1, 4096):
        block = "".join(chr(p) for p in range(at, min(at + 4096, sys.maxunicode + 1)) if not 0xD800 <= p < 0xE000)
        assert langid.has_letter(block) == any(c.isalpha() for c in block)
        others = "".join(c for c in block if not c.isalpha())
        assert not langid.has_letter(others)
    for char in (chr(p) for p in range(0x3400) if chr(p).isalpha()):
        assert langid.has_letter(f"1 {char}²")


def test_numbers_have_no_language(spark, clashing, sf_dir):
    model = langid.train(table(spark, sf_dir, "documents"))
    rows = [(1, "²"), (2, "½ ①"), (3, "Ⅷ"), (4, "² a")]
    got = {r.id: (r.lang_pred, r.score) for r in langid.predict(clashing(rows), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model.languages
    assert [r.doc_id for r in langid.keep_identified(clashing(rows), model, 0.0).collect()] == [4]


def test_lost_labels_do_not_change_predictions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    again = langid.train(docs.withColumn("lang", F.when(~held_out(), F.col("lang")).otherwise("xx")).where(~held_out()))
    assert (model.table == again.table).all() and model.temperature == again.temperature


def test_quality_of_held_out_documents(spark, larger):
    docs, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    found = op5_quality(spark, larger)
    rows = found.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert found.count() == docs.count() and held
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_odd_texts_have_a_quality(spark, clashing):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "good words are plain here " * 5), (5, "!!! $$$ ### " * 9), (6, "é ß " * 500_000)]
    labels = spark.createDataFrame([(4, 1), (5, 0), (9, 1), (None, 0), (3, None)], "doc_id bigint, quality int")
    got = quality.score(clashing(rows), labels, F.lit(True)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    scores = {r.id: (r.score, r.predicted) for r in got}
    assert scores[4][1] == 1 and scores[5][1] == 0 and scores[4][0] > scores[5][0]
    assert {r.score for r in quality.score(clashing(rows), labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.score(clashing(rows).limit(0), labels, F.lit(True)).count() == 0


def test_pipeline_stages_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bench = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    model = langid.train(docs.where(~held_out()))
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}

    def ids(name, kept):
        out = stages[name](spark, docs.where(F.col("doc_id").isin(kept)), sf_dir)
        assert name == "byte_bpe" or out.columns == docs.columns
        return sorted(r.doc_id for r in out.select("doc_id").collect())

    kept = sorted(texts)
    predicted = {i: model.predict(texts[i] or "") for i in kept}
    want = [i for i in kept if predicted[i][0] != "und" and predicted[i][1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    assert ids("language_id", kept) == want
    kept = want
    last = {(texts[i] or "").encode().lower(): i for i in kept}
    want = sorted(last.values())
    assert ids("exact_dedup", kept) == want
    kept = want
    want, near = brute_leaders([(i, texts[i]) for i in kept])
    assert ids("near_dedup", kept) == want and near
    kept = want
    want = [i for i in kept if not brute_contamination(texts[i], bench)]
    assert ids("decontamination", kept) == want
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert sorted(got) == want
    assert all(got[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i in want)
