"""Filtered top-k retrieval for a whole table of requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions.text import strip_space
from filigree.operators import terms as tf
from filigree.operators.topk import TermScorer, VectorScorer, top_k
from filigree.session import materialize


def normalize_companies(companies: Column, kind: str) -> Column:
    """Company list of a request: a single name becomes a list, other types become null."""
    if kind == "string":
        return F.array(companies)
    if kind.startswith("array"):
        return companies.cast("array<string>")
    return F.lit(None).cast("array<string>")


def valid_query(requests: DataFrame) -> DataFrame:
    """Requests whose question is not blank."""
    return requests.filter(strip_space(F.col("query")) != "")


def filter_companies(chunks: DataFrame, companies: list[str] | None) -> DataFrame:
    """Chunks of the companies; all chunks without a list. Reaches the partition filter."""
    return chunks.filter(F.col("ticker").isin(companies)) if companies else chunks


def embed(df: DataFrame, fn: Callable, text: str = "content") -> DataFrame:
    """Add `embedding` with the caller's pandas UDF (string -> array<float>)."""
    return df.withColumn("embedding", fn(F.col(text)).cast("array<float>"))


def _with_payload(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fetch the chunk columns of the hits; the ticker in the key prunes a collection's partitions."""
    return chunks.join(found, ["ticker", "chunk_id"]).select(
        "query_id", "rank", "score", "chunk_id",
        *[c for c in chunks.columns if c not in ("chunk_id", "ticker", "embedding")],
    )


def knn_search(vectors: DataFrame, requests: DataFrame, k: int = 3) -> DataFrame:
    """The k chunks nearest to each request by cosine, within the request's companies.

    `vectors`: chunk_id, ticker, embedding and any payload; `requests`: query_id, companies,
    embedding. A vector with a null or NaN element is no hit and has none; lengths must agree.
    """
    corpus = vectors.filter(F.col("embedding").isNotNull()).select("chunk_id", "ticker", "embedding")
    asked = requests.filter(F.col("embedding").isNotNull()).select("query_id", "companies", "embedding")
    return _with_payload(top_k(corpus, asked, VectorScorer, k), vectors)


@dataclass(frozen=True)
class TermIndex:
    """`terms` has the counted terms of every chunk and the length of its tf-idf vector."""

    chunks: DataFrame
    terms: DataFrame
    words: tf.Vocabulary


def term_index(chunks: DataFrame) -> TermIndex:
    """Index chunks (chunk_id, ticker, content, ...) for `lexical_search`.

    The texts are tokenized once. Counted terms, document frequencies and lengths are stored, so a search
    only reads them.
    """
    counted = materialize(tf.counted_terms(chunks, ["chunk_id", "ticker"], "content"), "terms")
    words = tf.vocabulary(counted)
    sums = tf.idf_sums(counted, ["chunk_id", "ticker"], words)
    stored = materialize(sums.select("chunk_id", "ticker", "terms", "counts", "norm"), "term-index")
    return TermIndex(chunks, stored, words)


def _weighted(requests: DataFrame, words: tf.Vocabulary) -> DataFrame:
    """(query_id, companies, terms, weights): tf * idf * idf over the length of the tf-idf vector.

    One idf is the request's own, the other belongs to the chunk side of the product, which
    therefore needs only its counts and its length.
    """
    keys = ["query_id", "companies"]
    rows = tf.with_idf(tf.counted_terms(requests, keys, "query"), keys, words)
    own = F.col("tf") * F.col("idf")
    grouped = rows.groupBy(*keys).agg(
        F.collect_list(F.struct("term", (own * F.col("idf")).alias("w"))).alias("pairs"),
        F.sqrt(F.sum(own * own)).alias("norm"),
    )
    return grouped.select(
        *keys, F.col("pairs.term").alias("terms"),
        F.transform("pairs", lambda p: p["w"] / F.col("norm")).alias("weights"),
    )


def lexical_search(index: TermIndex, requests: DataFrame, k: int = 3) -> DataFrame:
    """The k chunks with the highest tf-idf cosine per request; chunks without a shared term are no hits."""
    asked = _weighted(valid_query(requests), index.words)
    return _with_payload(top_k(index.terms, asked, TermScorer, k), index.chunks)


def retrieve_sections(index: TermIndex, requests: DataFrame) -> DataFrame:
    """The retriever tool: blank questions give nothing, five chunks otherwise."""
    return lexical_search(index, requests, k=5)
