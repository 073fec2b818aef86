"""The numbered operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import (
    bpe, cuckoo, decontam, langid, licenses, linkrank, quality, ranked, secrets, simhash, tokenfile, trie, warc,
)

END_ID = 2
FOLDS = 5
RULES = [
    linkrank.Rule("allow", "com/"), linkrank.Rule("block", "example.com/en/"), linkrank.Rule("allow", "www.example.com/en/"),
    linkrank.Rule("block", "net/es/"), linkrank.Rule("block", "net/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.scan(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op3_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkrank.judge(table(spark, sf_dir, "pages"), RULES).withColumnRenamed("id", "page_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs.where(~held_out())))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")


def op6_licence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licences(table(spark, sf_dir, "documents"), licenses.known_digests(spark))
    return found.withColumnRenamed("id", "doc_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cuckoo.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID
    )
    found = tokenfile.read_token_files(manifest)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document and benchmark item it holds; clean documents have none."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "similarity", "start", "shingles")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return found.withColumnRenamed("id", "doc_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked.nra_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_url_verdicts": op3_url_verdicts,
    "op4_language_id": op4_language_id,
    "op5_quality": op5_quality,
    "op6_licence_texts": op6_licence_texts,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_files": op8_token_files,
    "op9_decontamination": op9_decontamination,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ranked_search": op12_ranked_search,
    "op13_warc": op13_warc,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE: dict[str, str] = {
    "op2_secret_scan": secrets.oracle_sql(),
    "op3_url_verdicts": linkrank.oracle_sql(RULES),
    "op6_licence_texts": licenses.oracle_sql(),
    "op7_exact_dedup": f"""
        with d as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as text_sha256 from documents),
        g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, d.text_sha256
        from d join g using (text_sha256)""",
    "op11_prefix_trie": trie.oracle_sql(),
    "op12_ranked_search": ranked.oracle_sql(),
    "op13_warc": warc.oracle_sql(),
}
