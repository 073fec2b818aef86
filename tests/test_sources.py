"""A filing tree on disk, the collection and the stream."""

import pytest
from pyspark.sql import functions as F

from filigree.plans.ingest import filing_documents, ingest
from filigree.sources import companies as B
from filigree.sources import filings as E
from filigree.sources.collection import open_collection, write_chunks
from filigree.streaming.ingest_stream import ingest_stream, read_document_stream

PAGE = "<html><body><p>Item 1A. Risk Factors</p><p>Risk {0}.</p><p>Item 7. MD</p><p>Growth {0}.</p></body></html>"


@pytest.fixture
def tree(tmp_path):
    def put(ticker, accession, name, data):
        folder = tmp_path / "sec-edgar-filings" / ticker / "10-K" / accession
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())

    put("AAPL", "0000000001-22-000001", "primary.htm", PAGE.format("old"))
    put("AAPL", "0000000001-23-000009", "Main.HTML", PAGE.format("upper"))
    put("AAPL", "0000000001-23-000009", "full-submission.txt", "Item 7. no\nwrong file")
    put("AAPL", "0000000001-99-000001", "primary.htm", PAGE.format("1999"))
    put("MSFT", "0000000002-23-000001-extra", "full-submission.txt", b"Item 7. MD\nbad \xff byte")
    put("MSFT", "drafts", "primary.htm", PAGE.format("draft"))
    put("MSFT", "0000000002-22-000001", "exhibit.pdf", "Item 7. x\nno")
    put("OTHER", "0000000003-23-000001", "primary.htm", PAGE.format("other"))
    return str(tmp_path)


def test_listing(spark, tree):
    files = E.filing_files(spark, tree)
    assert files.count() == 8
    got = {(r.ticker, r.accession_number) for r in E.list_filings(files).collect()}
    assert got == {
        ("AAPL", "0000000001-22-000001"), ("AAPL", "0000000001-23-000009"), ("MSFT", "0000000002-23-000001-extra"),
        ("MSFT", "0000000002-22-000001"), ("OTHER", "0000000003-23-000001"),
    }
    picks = {r.accession_number: r.file_name for r in E.pick_primary_document(files).collect()}
    assert picks["0000000001-23-000009"] == "Main.HTML"
    assert picks["0000000002-23-000001-extra"] == "full-submission.txt"
    assert "0000000002-22-000001" not in picks


def test_documents(spark, tree):
    companies = spark.createDataFrame([("aapl", "Apple"), ("MSFT", "")], "ticker string, name string")
    got = {r.accession_number: r for r in filing_documents(spark, tree, companies).collect()}
    assert {key for key, row in got.items() if row.text is not None} == {
        "0000000001-22-000001", "0000000001-23-000009", "0000000002-23-000001-extra"}
    assert all(got[key].file_name is None for key in got if got[key].text is None)
    assert got["0000000001-23-000009"].company == "Apple"
    assert "Risk upper." in got["0000000001-23-000009"].text
    assert got["0000000002-23-000001-extra"].text == "Item 7. MD\nbad � byte"


def test_ingest_twice(spark, tree, tmp_path):
    path = str(tmp_path / "collection")
    companies = spark.createDataFrame([("AAPL", "Apple"), ("MSFT", "")], "ticker string, name string")
    ingest(spark, tree, companies, path)
    first = {r.chunk_id: r for r in open_collection(spark, path).collect()}
    assert len(first) == 5
    assert {r.metadata.company for r in first.values()} == {"Apple", "MSFT"}
    ingest(spark, tree, companies, path)
    assert open_collection(spark, path).count() == 5
    names = {r.ticker: r.name for r in B.list_companies(
        open_collection(spark, path).select("ticker", "metadata.company"), B.companies_dim(spark)).collect()}
    assert names == {"AAPL": "Apple Inc.", "MSFT": "Microsoft Corporation"}


def test_embedder(spark, tree, tmp_path):
    import pandas as pd

    @F.pandas_udf("array<float>")
    def length(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 1.0])

    path = str(tmp_path / "collection")
    companies = spark.createDataFrame([("AAPL", "Apple")], "ticker string, name string")
    ingest(spark, tree, companies, path, embedder=length)
    for row in open_collection(spark, path).collect():
        assert list(row.embedding) == [len(row.content), 1.0]


def test_ticker_filter_prunes_partitions(spark, tree, tmp_path):
    from filigree.operators.retrieval import filter_companies

    path = str(tmp_path / "collection")
    ingest(spark, tree, spark.createDataFrame([("AAPL", "A"), ("MSFT", "M")], "ticker string, name string"), path)
    stored = open_collection(spark, path)
    wanted = filter_companies(stored, ["MSFT"])
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan or "PartitionFilters: [ticker" in plan
    assert {r.ticker for r in wanted.collect()} == {"MSFT"}
    assert filter_companies(stored, []).count() == stored.count() == filter_companies(stored, None).count()


def test_stream(spark, tmp_path):
    schema = ("ticker string, filing_type string, accession_number string, company string, filing_date string, text string")
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = [("A", "10-K", "1", "", "", "Item 7. x\none"), ("A", "10-K", "1", "", "", "Item 7. x\none"), ("B", "10-K", "2", "", "", "Item 7. x\ntwo")]
    spark.createDataFrame(first, schema).write.mode("append").parquet(source)
    types = spark.createDataFrame([], schema).schema

    def run():
        ingest_stream(read_document_stream(spark, source, types), path, state)
        return open_collection(spark, path).count()

    assert run() == 2
    assert run() == 2
    spark.createDataFrame([*first[:1], ("C", "10-K", "3", "", "", "Item 1A. x\nthree")], schema).write.mode("append").parquet(source)
    assert run() == 3


def test_write_drops_repeats_in_batch(spark, tmp_path):
    from filigree.schemas import CHUNKS

    path = str(tmp_path / "c")
    meta = ("A", "A", "10-K", "Unknown", "1", "s", 0)
    rows = spark.createDataFrame([("id", "x", meta), ("id", "x", meta)], CHUNKS).withColumn("ticker", F.lit("A"))
    write_chunks(rows, path)
    write_chunks(rows.limit(0), path)
    assert open_collection(spark, path).count() == 1


def test_company_lists(spark):
    dim = B.companies_dim(spark)
    assert [r.ticker for r in B.search_companies(dim, "MICRO").collect()] == ["MSFT"]
    rows = spark.createDataFrame([("AAPL",), ("ZZZ",), ("TSLA",)], "ticker string")
    assert {r.ticker: r.display_name for r in B.company_display_name(rows, B.display_names(spark)).collect()} == {
        "AAPL": "Apple", "ZZZ": "ZZZ", "TSLA": "Tesla"}
    assert [r.ticker for r in B.selectable_company(rows, dim).collect()] == ["AAPL"]


def test_documents_are_read_by_many_tasks(spark, tmp_path):
    """The paths are few bytes, which adaptive execution would give to one task."""
    rows = []
    for i in range(64):
        (tmp_path / f"{i}.htm").write_text(f"page {i}")
        rows.append((i, str(tmp_path / f"{i}.htm")))
    found = E.read_documents(spark.createDataFrame(rows, "n long, path string"))
    got = [(r.n, r.text, r.task) for r in found.select("n", "text", F.spark_partition_id().alias("task")).collect()]
    assert {(n, text) for n, text, _ in got} == {(i, f"page {i}") for i in range(64)} and len({task for *_, task in got}) > 1
