"""The filing tree as a source: every file once, and a stream that goes on where it stopped."""

import os
import time

from pyspark.sql import functions as F

from filigree.sources.filings import list_filings, pick_primary_document, read_documents
from filigree.sources.tree import Tickers, filing_tree, filing_tree_stream, ticker_tasks

ONE, TWO = "0000000001-21-000001", "0000000002-22-000002"


def put(root, ticker, accession, name, text="x", kind="10-K"):
    folder = os.path.join(root, "sec-edgar-filings", ticker, kind, accession)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as file:
        file.write(text)


def test_every_file_of_the_tree(spark, tmp_path):
    root = str(tmp_path)
    put(root, "AAPL", ONE, "a.htm", "apple")
    put(root, "AAPL", ONE, "full-submission.txt")
    put(root, "MSFT", TWO, "full-submission.txt", "soft é", "10-Q")
    put(root, "MSFT", "odd", "b c.htm")
    os.makedirs(os.path.join(root, "sec-edgar-filings", "EMPTY", "10-K"))
    with open(os.path.join(root, "sec-edgar-filings", "AAPL", "note.txt"), "w") as file:
        file.write("not at a filing's depth")
    files = filing_tree(spark, root)
    got = sorted((r.ticker, r.filing_type, r.accession_number, r.file_name) for r in files.collect())
    assert got == [("AAPL", "10-K", ONE, "a.htm"), ("AAPL", "10-K", ONE, "full-submission.txt"),
                   ("MSFT", "10-K", "odd", "b c.htm"), ("MSFT", "10-Q", TWO, "full-submission.txt")]
    assert files.rdd.getNumPartitions() == 3
    assert {(r.ticker, r.accession_number) for r in list_filings(files).collect()} == {("AAPL", ONE), ("MSFT", TWO)}
    texts = {r.accession_number: r.text for r in read_documents(pick_primary_document(files)).collect()}
    assert texts == {ONE: "apple", TWO: "soft é", "odd": "x"}


def test_a_missing_tree_has_no_files(spark, tmp_path):
    assert filing_tree(spark, f"{tmp_path}/none").count() == 0


def test_tickers_share_tasks(tmp_path, monkeypatch):
    for i in range(7):
        put(str(tmp_path), f"T{i}", ONE, "a.htm")
    monkeypatch.setattr("filigree.sources.tree.MOST_TASKS", 3)
    parts = ticker_tasks(str(tmp_path), -1, 5)
    assert [p.names for p in parts] == [["T0", "T3", "T6"], ["T1", "T4"], ["T2", "T5"]] and all(isinstance(p, Tickers) for p in parts)


def test_a_stream_reads_new_filings_only(spark, tmp_path):
    root, seen = f"{tmp_path}/tree", f"{tmp_path}/seen"

    def run():
        stream = filing_tree_stream(spark, root, 0).select("ticker", "accession_number", "file_name", F.col("modified"))
        query = stream.writeStream.format("parquet").option("path", seen).option("checkpointLocation", f"{tmp_path}/check")
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.ticker, r.accession_number) for r in spark.read.parquet(seen).collect())

    put(root, "AAPL", ONE, "a.htm")
    assert run() == [("AAPL", ONE)]
    time.sleep(0.05)
    put(root, "AAPL", TWO, "a.htm")
    put(root, "NEW", ONE, "a.htm")
    assert run() == [("AAPL", ONE), ("AAPL", TWO), ("NEW", ONE)]
    assert run() == [("AAPL", ONE), ("AAPL", TWO), ("NEW", ONE)]
