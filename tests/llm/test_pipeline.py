"""The pipeline as a whole, and operators on tables without rows."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from filigree.llm import bpe, langid, licenses, linkrank
from filigree.llm.queries import RULES, table

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars int, row string"


def folder(spark, tmp_path, rows, items):
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_a_corpus_with_odd_rows(spark, sf_dir, tmp_path):
    given = [(r.doc_id, r.text, r.lang, r.source, 1, "x") for r in table(spark, sf_dir, "documents").collect()]
    passage = "the quick brown fox jumps over the lazy dog near the river bank and then it runs away into the dark forest at night"
    long_text = " ".join(f"the word and {i} of text" for i in range(200))
    own = [(90_001, None, "en", "s", 1, "x"), (90_002, "", "en", "s", 1, "x"), (90_003, "²½ 123 !!", "en", "s", 1, "x"),
           (90_004, long_text, "en", "s", 1, "x"), (90_005, long_text.upper(), "en", "s", 1, "x"), (90_006, long_text + " end", "en", "s", 1, "x"),
           (90_007, f"and so the story of the fox begins: {passage} . that was the end of the story", "en", "s", 1, "x")]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()] + [(9_999, passage), (None, None), (9_998, "")]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder(spark, tmp_path, given + own, items)).collect()}
    # No letter; equal but for case (the larger id stays); a near copy (the smaller id stays); a benchmark passage.
    assert not {90_001, 90_002, 90_003, 90_004, 90_007} & set(got) and len({90_005, 90_006} & set(got)) == 1
    assert got[90_005].decoded_sha256 == hashlib.sha256(long_text.upper().encode()).hexdigest()
    assert len(got) > 0.6 * len(given)


def test_an_empty_corpus(spark, sf_dir, tmp_path):
    found = corpus_pipeline.run(spark, folder(spark, tmp_path, [], [(1, "an item")]))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and found.count() == 0


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumns({"id": F.lit(1), "text_id": F.lit("x"), "row": F.lit(2.0), "th": F.lit(3), "num": F.lit(True)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs.limit(30), docs.limit(0)):
            out = stage(spark, given, sf_dir)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() <= given.count(), name


def test_operators_on_empty_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    none = docs.limit(0)
    assert langid.predict(none, langid.train(docs)).count() == 0
    assert linkrank.judge(table(spark, sf_dir, "pages").limit(0), RULES).count() == 0
    assert licenses.find_licences(none, licenses.known_digests(spark)).count() == 0
    assert bpe.round_trip(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
