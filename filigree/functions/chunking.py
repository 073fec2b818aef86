"""Cut text into overlapping chunks with one linear pass of a regular expression.

A text is first cut into strides (size - overlap characters); chunk i is stride i plus the
first `overlap` characters of stride i + 1. `substring` by position would scan from the start
of the text for every chunk, which is quadratic on filings of several megabytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.rules import CHUNK_OVERLAP, CHUNK_SIZE


SEPARATORS = [r"\n\n", r"\n", " "]


def stride_pattern(size: int, overlap: int, snap: bool | str) -> str:
    """Pattern of one stride.

    With `snap` a stride ends after white space where it can. With `snap="recursive"` it ends after
    the last blank line inside, else after the last line break, else after the last blank, else it is cut.
    """
    stride = size - overlap
    if not 0 <= overlap <= stride:
        raise ValueError("overlap must not exceed half of the chunk size")
    if snap == "recursive":
        ends = "".join(rf"|.{{1,{stride - len(s.replace(chr(92), ''))}}}{s}" for s in SEPARATORS)
        return rf"(?s).{{1,{stride}}}\z{ends}|.{{1,{stride}}}"
    if snap:
        return rf"(?s).{{1,{stride}}}\z|.{{1,{stride - 1}}}\s|.{{1,{stride}}}"
    return rf"(?s).{{1,{stride}}}"


def strides(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, snap: bool | str = False) -> Column:
    return F.regexp_extract_all(text, F.lit(stride_pattern(size, overlap, snap)), F.lit(0))


def chunk_rows(
    df: DataFrame,
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    snap: bool | str = False,
) -> DataFrame:
    """One row per chunk: the other columns, `chunk_index` from 0 and `content`.

    Empty or null text gives no row. The last stride is dropped when the chunk before it
    already holds all of it.
    """
    keep = [F.col(c) for c in df.columns if c != text]
    cut = df.filter(F.length(text) > 0).select(*keep, strides(F.col(text), size, overlap, snap).alias("_strides"))
    parts = F.col("_strides")
    tail_is_covered = (F.size(parts) > 1) & (F.length(F.element_at(parts, -1)) <= overlap)
    count = F.size(parts) - F.when(tail_is_covered, 1).otherwise(0)
    chunks = F.transform(
        F.slice(parts, F.lit(1), count),
        lambda part, i: F.concat(part, F.left(F.coalesce(F.get(parts, i + 1), F.lit("")), F.lit(overlap))),
    )
    return cut.select(*keep, F.posexplode(chunks).alias("chunk_index", "content"))
