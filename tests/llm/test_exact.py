"""Exact dedup, token files and byte-level BPE against plain Python over whole small tables."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filigree.llm import bpe, cuckoo, pretokens, tokenfile
from filigree.llm.queries import op7_exact_dedup, op8_token_files, op10_byte_bpe, table

ODD = [
    (1, None), (2, ""), (3, "   "), (4, "it's  they'll\n\n 'S x's 12½ ² \u0085end "), (5, "日本語 ελ \U0001f600 á"),
    (6, "Same Text"), (7, "sAME tEXT"), (7, "Same Text"), (8, "ÉÀ É"), (9, "éà é"), (None, "Same Text"), (None, "alone"),
    (10, "<|endoftext|> and <|endoftext|>"), (11, "long word " * 40_000), (12, "a" * 5_000), (13, "\x1c\x1d x\x00y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, digest string, start int").repartition(3)


def lower(text):
    return (text or "").encode().lower()


def check_groups(rows, docs):
    groups: dict = {}
    for i, text in docs:
        groups.setdefault(lower(text), []).append(i)
    assert len(rows) == len(docs)
    expected = sorted(
        (str(i), str(max((x for x in groups[lower(t)] if x is not None), default=None)), len(groups[lower(t)]),
         hashlib.sha256(lower(t)).hexdigest()) for i, t in docs
    )
    assert sorted((str(r[0]), str(r[1]), r[2], r[4]) for r in rows) == expected
    assert all(r[3] == (r[0] == r[1]) for r in rows)


def test_exact_groups_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    check_groups([tuple(r) for r in op7_exact_dedup(spark, sf_dir).collect()], [tuple(r) for r in docs])


def test_exact_groups_of_odd_rows(spark, odd):
    found = cuckoo.exact_duplicates(odd).select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    check_groups([tuple(r) for r in found.collect()], ODD)
    assert cuckoo.exact_duplicates(odd.limit(0)).count() == 0


def test_dropping_leaves_one_row_of_each_text(spark, odd):
    doubled = odd.union(odd)
    left = cuckoo.drop_exact_duplicates(doubled)
    assert left.columns == odd.columns
    texts = [lower(r.text) for r in left.collect()]
    assert sorted(texts) == sorted({lower(t) for _, t in ODD})
    assert cuckoo.drop_exact_duplicates(odd.limit(0)).count() == 0


def test_filter_inserts_deletes_and_grows():
    rng = random.Random(1)
    keys = [rng.randbytes(32) for _ in range(3_000)]
    shard = cuckoo.Shard(buckets=2)
    for i, key in enumerate(keys):
        shard.add(key, i, 1)
        shard.add(key, i - 1, 2)
    assert shard.resized > 5
    assert [shard.keep[shard.find(k)] for k in keys] == list(range(len(keys)))
    assert {shard.sizes[shard.find(k)] for k in keys} == {3}
    assert sum(shard.find(rng.randbytes(32)) >= 0 for _ in range(1_000)) == 0
    for key in keys[::2]:
        assert shard.remove(key)
    assert not shard.remove(keys[0])
    assert [shard.find(k) >= 0 for k in keys[:6]] == [False, True] * 3
    assert all(not shard.filter.hits(k) or shard.find(k) < 0 for k in keys[::2])


def test_index_takes_batches_and_deletions(spark, sf_dir):
    digests = cuckoo.text_digests(table(spark, sf_dir, "documents"))
    first, second = digests.where("id % 2 = 0"), digests.where("id % 2 = 1")
    index = cuckoo.insert(cuckoo.insert(cuckoo.empty_index(spark, 3), first), second)
    once = cuckoo.insert(cuckoo.empty_index(spark, 3), digests)
    columns = ["digest", "keep_id", "group_size"]
    assert sorted(map(tuple, index.keys.select(*columns).collect())) == sorted(map(tuple, once.keys.select(*columns).collect()))
    gone = cuckoo.delete(index, first)
    found = cuckoo.lookup(gone, digests)
    left = {bytes(r.digest) for r in second.collect()} - {bytes(r.digest) for r in first.collect()}
    assert {bytes(r.digest) for r in found.where("keep_id is not null").collect()} == left
    assert found.count() == digests.count()


def test_codec_equals_the_library(spark, sf_dir, odd):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    for rows, texts in ((op10_byte_bpe(spark, sf_dir).collect(), docs),
                        (bpe.round_trip(odd, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect(), ODD)):
        expected = []
        for i, text in texts:
            ids = np.array(library.encode_ordinary(text or ""), "<u4")
            expected.append((str(i), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                             hashlib.sha256((text or "").encode()).hexdigest()))
        assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted(expected)


def test_every_character_is_split_as_the_library_does():
    vocabulary = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    codec = bpe.Codec(vocabulary)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = [*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x33000, 11)]
    for at in range(0, len(points), 512):
        text = "".join(f"a{chr(p)}b {chr(p)}1{chr(p)}'s" for p in points[at:at + 512] if not 0xD800 <= p < 0xE000)
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_encode_and_decode_tables(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(odd, path, public_tokenizers.PATTERN)
    texts = [r.text for r in bpe.decode(encoded, path, public_tokenizers.PATTERN).collect()]
    assert sorted(texts) == sorted(t or "" for _, t in ODD)
    assert bpe.encode(odd.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_ranks_with_gaps_keep_their_numbers(tmp_path):
    entries = [(bytes([b]), 3 * b) for b in range(256)] + [(b"ab", 1000), (b"abc", 2000), (b"xyz", 1500)]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in entries))
    codec = bpe.Codec(bpe.vocabulary(str(path), public_tokenizers.PATTERN))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(entries), special_tokens={})
    for text in ("abcab xyz", "abc", "xyz", "zabcz"):
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def expected_tokens(texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, out = 0, []
    for i, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_hold_all_documents_in_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, op8_token_files(spark, sf_dir).collect())) == expected_tokens(docs)


def test_token_files_of_odd_rows(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = tokenfile.read_token_files(tokenfile.write_token_files(odd, path, 2, length=7))
    rows = found.select("id", "start", "n_tokens", F.crc32("ids")).orderBy("start").collect()
    ids = [r[0] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = expected_tokens(ODD)
    assert sorted((str(r[0]), r[2], r[3]) for r in rows) == sorted((str(w[0]), w[2], w[3]) for w in want)
    starts = [0]
    for r in rows:
        assert r[1] == starts[-1]
        starts.append(starts[-1] + r[2])
    empty = tokenfile.write_token_files(odd.limit(0), path, 2)
    assert tokenfile.read_token_files(empty).count() == 0


def test_added_tokens_are_those_of_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        encoder = tokenfile.Encoder(file.read())
    library = Tokenizer.from_file(path)
    for text in ("a<|endoftext|>b", "<|endoftext|>", " <|endoftext|><|endoftext|> x", "<|endoftext|", "é日<|endoftext|>", "plain text"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_remembered_pre_tokens_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(pretokens, "CACHED_BYTES", 10_000)
    cache = pretokens.IdCache(lambda words: [w.encode() * 4 for w in words])
    for i in range(300):
        words = [f"w{i}", "x" * 100 + str(i), "y" * 5000 + str(i)]
        assert cache.ids([*words, *words]) == b"".join(w.encode() * 4 for w in [*words, *words])
        assert cache.held < 12_000 and all(len(w) <= pretokens.LONGEST for w in cache.known)
        assert cache.held >= sum(len(w) + len(ids) for w, ids in cache.known.items())


def test_sequences_are_reached_without_a_copy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = tokenfile.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, length=64).first()
    file = tokenfile.SequenceFile(f"{part.path}.arrow")
    n = -(-part.n_tokens // 64)
    ids, mask = file[n - 1]
    assert ids.shape == (64,) and len(mask) == 64 and not ids.flags.owndata
    assert mask.true_count == part.n_tokens - 64 * (n - 1)
    assert all(file[i][1].true_count == 64 for i in range(n - 1))
