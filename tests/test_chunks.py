"""Chunking, sections, page text and addresses."""

from pyspark.sql import functions as F

from filigree.functions import text as X
from filigree.functions.chunking import chunk_rows, strides
from filigree.operators.chunks import extract_sections, process_filing
from filigree.plans import standins as D
from filigree.rules import TARGET_SECTIONS


def by_position(text, size=1000, overlap=100):
    """Brute force: fixed strides until the text is covered."""
    out, start = [], 0
    while text:
        out.append(text[start:start + size])
        if start + size >= len(text):
            return out
        start += size - overlap
    return out


def test_fixed_chunks(spark):
    texts = ["", "a", "x" * 100, "é" * 999, "ab" * 500, "z" * 1001, "q" * 1900, "w" * 1901, "\n é😀" * 1234, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {}
    for row in chunk_rows(df).orderBy("id", "chunk_index").collect():
        got.setdefault(row.id, []).append(row.content)
    assert got == {i: by_position(t) for i, t in enumerate(texts) if t}


def test_snapped_strides_rebuild_text(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select("text", strides(F.col("text"), snap=True).alias("s")).collect()
    cut_words = 0
    for row in docs:
        assert "".join(row.s) == row.text
        assert all(0 < len(s) <= 900 for s in row.s)
        cut_words += sum(1 for s in row.s[:-1] if not s[-1].isspace() and any(c.isspace() for c in s))
    assert cut_words == 0


def test_snapped_chunks_overlap(spark):
    text = " ".join(f"word{i}" for i in range(1000))
    df = spark.createDataFrame([(text,)], "text string")
    chunks = [r.content for r in chunk_rows(df, snap=True).orderBy("chunk_index").collect()]
    assert all(len(c) <= 1000 for c in chunks)
    for a, b in zip(chunks, chunks[1:]):
        assert a[-100:] == b[:100]


FILING = """Contents
Item 1. Business
Item 1A. Risk Factors
Item 7. Discussion
PART I
ITEM 1. Business
We sell things.
  item 1a.  Risk Factors
Prices may fall.
See Item 7 for more.
Item 1B. Unresolved
none
Item 7. Discussion
Revenue grew.

Item 7A. Market risk
rates"""


def test_sections(spark):
    df = spark.createDataFrame([(1, FILING), (2, "no headings"), (3, "Item 7. last\nthe end"), (4, "Item 7.\n \n")], "id int, text string")
    got = {(r.id, r.section): r.text for r in extract_sections(df).collect()}
    risk, md = TARGET_SECTIONS["1A"], TARGET_SECTIONS["7"]
    assert got == {
        (1, risk): "Prices may fall.\nSee Item 7 for more.", (1, md): "Revenue grew.", (3, md): "the end",
    }
    whole = extract_sections(df, None).filter("id = 2").collect()
    assert [(r.section, r.text) for r in whole] == [("Full Document", "no headings")]


def test_metadata_defaults(spark):
    rows = [("AAPL", "10-K", "1-2-3", "", "", "Item 7. x\nbody"), ("MSFT", "10-K", "1-2-3", "Microsoft", "2024-01-02", "Item 7. x\nbody")]
    df = spark.createDataFrame(rows, "ticker string, filing_type string, accession_number string, company string, filing_date string, text string")
    got = {r.ticker: r for r in process_filing(df).collect()}
    assert (got["AAPL"].metadata.company, got["AAPL"].metadata.date) == ("AAPL", "Unknown")
    assert (got["MSFT"].metadata.company, got["MSFT"].metadata.date) == ("Microsoft", "2024-01-02")
    assert got["AAPL"].chunk_id.startswith("AAPL_10-K_1-2-3_Management")
    assert len({r.chunk_id for r in got.values()}) == 2


def test_page_text(spark):
    html = ("<html><head><script>var a='</p>';</script><style>p{}</style></head><body><h1>Item 7. A &amp; B</h1>"
            "<p>one<br/>two&nbsp;<b>bo</b>ld</p><!-- <p>no</p> --><table><tr><td>x</td><td>y</td></tr></table></body></html>")
    df = spark.createDataFrame([(html,), ("plain",)], "html string")
    got = [r.t for r in df.select(X.html_to_text(F.col("html")).alias("t")).collect()]
    assert got == ["Item 7. A & B\none\ntwo bold\nxy", "plain"]


def test_filing_url(spark):
    rows = [("0000320193-23-000106", "/a/b/doc.htm"), ("123-23-1", "x.htm"), ("123456789012-23-000001", "y"), ("bad", "z.htm")]
    df = spark.createDataFrame(rows, "acc string, path string")
    got = [r.u for r in df.select(X.filing_url(F.col("acc"), F.col("path")).alias("u")).collect()]
    base = "https://www.sec.gov/Archives/edgar/data/"
    assert got == [
        base + "0000320193/000032019323000106/doc.htm", base + "0000000123/123231/x.htm",
        base + "123456789012/12345678901223000001/y", base + "0000000000/bad/z.htm",
    ]


def test_years_and_selection_note(spark):
    df = spark.createDataFrame(
        [("2023-05-01", "in 2021, 1999 and 2021; 18999 no", "q (Companies selected: A, B) (Companies selected: C)", ["A"]),
         ("Unknown", "none", " \t plain\n", []), ("1800-01-01", "", "x", None)],
        "d string, c string, m string, s array<string>",
    )
    got = df.select(
        X.year_of_date(F.col("d")).alias("y"), X.years_in_text(F.col("c")).alias("ys"),
        X.strip_selection(F.col("m")).alias("m"), X.annotate_selection(F.lit("q"), F.col("s")).alias("a"),
    ).collect()
    assert [(r.y, r.ys) for r in got] == [(2023, [1999, 2021]), (None, []), (None, [])]
    assert [r.m for r in got] == ["q  (Companies selected: C)", "plain", "x"]
    assert [r.a for r in got] == ["q (Companies selected: A)", "q", "q"]
