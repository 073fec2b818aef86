"""Documents to sections to chunk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree import rules as R
from filigree.functions import sections as S
from filigree.functions import text as X
from filigree.functions.chunking import chunk_rows

DOCUMENT_KEY = ["ticker", "filing_type", "accession_number", "company", "filing_date"]


def extract_sections(documents: DataFrame, targets: dict[str, str] | None = R.TARGET_SECTIONS) -> DataFrame:
    """(other columns, section, text): the target items of each document, blank ones dropped.

    Items are found by the sequence of headings, as `filigree.functions.sections` states. Without targets the whole
    text is one section.
    """
    others = [c for c in documents.columns if c != "text"]
    if not targets:
        return documents.select(*others, F.lit(R.WHOLE_DOCUMENT).alias("section"), "text")
    cut = documents.select(*others, S.candidates(F.col("text")).alias("_pieces"))
    chained = cut.select("*", S.heading_chain(F.col("_pieces")).alias("_chain"))
    bodies = chained.select(*others, F.explode(S.section_bodies(F.col("_pieces"), F.col("_chain"))).alias("_s"))
    names = F.create_map(*[F.lit(x) for item, name in targets.items() for x in (item.upper(), name)])
    rows = bodies.select(*others, names[F.col("_s.item")].alias("section"), F.col("_s.body").alias("text"))
    return rows.filter(F.col("section").isNotNull() & (F.col("text") != ""))


def process_filing(
    documents: DataFrame,
    targets: dict[str, str] | None = R.TARGET_SECTIONS,
    size: int = R.CHUNK_SIZE,
    overlap: int = R.CHUNK_OVERLAP,
    snap: bool = False,
) -> DataFrame:
    """Chunk rows (chunk_id, content, metadata, ticker) of documents. No shuffle.

    `documents`: ticker, filing_type, accession_number, company, filing_date, text.
    """
    sections = extract_sections(documents.select(*DOCUMENT_KEY, "text"), targets)
    rows = chunk_rows(sections, "text", size, overlap, snap)
    key = [F.col(c) for c in ("ticker", "filing_type", "accession_number", "section", "chunk_index")]
    return rows.select(
        X.chunk_id(*key).alias("chunk_id"),
        "content",
        X.chunk_metadata(
            F.col("ticker"), F.col("company"), F.col("filing_type"), F.col("filing_date"),
            F.col("accession_number"), F.col("section"), F.col("chunk_index"),
        ).alias("metadata"),
        "ticker",
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks and characters per filing and section."""
    meta = [F.col(f"metadata.{c}").alias(c) for c in ("ticker", "filing_type", "accession_number", "section")]
    return chunks.groupBy(*meta).agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars")
    )
