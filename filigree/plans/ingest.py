"""Filing tree to collection, as one chain over the whole catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree import rules as R
from filigree.functions.text import html_to_text, main_document
from filigree.operators.chunks import process_filing
from filigree.operators.retrieval import embed
from filigree.session import materialize
from filigree.sources.collection import write_chunks
from filigree.sources.filings import FILING_KEY, company_filings, pick_primary_document, read_documents
from filigree.sources.tree import filing_tree


def filing_documents(
    spark: SparkSession, root: str, companies: DataFrame,
    filing_types: list[str] | None = None, limit: int = R.FILINGS_PER_TYPE,
) -> DataFrame:
    """Texts of the newest filings of the companies as plain text; of a full submission, its main document.

    The tree is listed once, by tasks. A filing without a document has a row with a null text.
    """
    files = materialize(filing_tree(spark, root).drop("modified"), "filing-files")
    filings = company_filings(files, companies, filing_types or R.FILING_TYPES, limit)
    picks = materialize(filings.join(pick_primary_document(files), FILING_KEY, "left"), "picks")
    documents = read_documents(picks.filter(F.col("path").isNotNull()))
    page = ~(F.col("file_name") == "full-submission.txt")
    text = html_to_text(F.when(page, F.col("text")).otherwise(main_document(F.col("text"))))
    columns = [*FILING_KEY, "company", F.lit("Unknown").alias("filing_date"), "file_name"]
    nothing = picks.filter(F.col("path").isNull()).select(*columns, F.lit(None).cast("string").alias("text"))
    return documents.select(*columns, text.alias("text")).unionByName(nothing)


def ingest(
    spark: SparkSession, root: str, companies: DataFrame, collection: str,
    filing_types: list[str] | None = None, limit: int = R.FILINGS_PER_TYPE,
    targets: dict[str, str] | None = R.TARGET_SECTIONS, embedder: Callable | None = None,
) -> DataFrame:
    """Read, cut, chunk, optionally embed, and append what is not stored yet.

    Returns a report: every filing with `state` (`no document`, `no section` or `read`) and its number of chunks.
    """
    documents = materialize(filing_documents(spark, root, companies, filing_types, limit), "documents")
    chunks = materialize(process_filing(documents.filter(F.col("text").isNotNull()), targets), "chunks")
    write_chunks(embed(chunks, embedder) if embedder else chunks, collection)
    keys = [F.col(f"metadata.{name}").alias(name) for name in FILING_KEY]
    counts = chunks.select(*keys).groupBy(*FILING_KEY).agg(F.count("*").alias("n_chunks"))
    state = F.when(F.col("text").isNull(), "no document").when(F.col("n_chunks").isNull(), "no section").otherwise("read")
    return documents.join(counts, FILING_KEY, "left").select(
        *FILING_KEY, state.alias("state"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")
    )
