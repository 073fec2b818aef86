"""A directory tree of downloaded filings as tables.

Layout: `<root>/sec-edgar-filings/<TICKER>/<type>/<accession>/<file>`. Listing never opens a
file: only `path` is read from the binary source. Contents are read for the chosen documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.functions.text import valid_utf8
from filigree.rules import FILINGS_PER_TYPE
from filigree.session import open_uri

TREE = r"/sec-edgar-filings/[^/]+/[^/]+/[^/]+/[^/]+$"
ACCESSION = r"^\d{10}-\d{2}-\d{6}"
FILING_KEY = ["ticker", "filing_type", "accession_number"]


def parse_paths(files: DataFrame) -> DataFrame:
    """Key columns and file name of every path of the tree; other paths give no row."""
    names = ["ticker", "filing_type", "accession_number", "file_name"]
    split = files.filter(F.col("path").rlike(TREE)).select("path", F.split("path", "/").alias("_parts"))
    return split.select("path", *[F.element_at("_parts", i - 4).alias(name) for i, name in enumerate(names)])


def filing_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, ticker, filing_type, accession_number, file_name) below a root folder."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return parse_paths(source.load(root).select(F.col("_metadata.file_path").alias("path")))


def valid_accession(accession: Column) -> Column:
    """Starts like an accession number; trailing text is accepted."""
    return accession.rlike(ACCESSION)


def accession_order(accession: Column) -> list[Column]:
    """Newest first: two-digit year (93 to 99 are 19xx), then sequence number, then the text."""
    year = F.substring(accession, 12, 2).try_cast("int")
    full = F.when(year >= 93, year + 1900).otherwise(year + 2000)
    return [full.desc(), F.substring(accession, 15, 6).try_cast("int").desc(), accession.desc()]


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per key. Each task drops all but n rows per key before the shuffle."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_n") <= n).drop("_n")


def list_filings(files: DataFrame, limit: int = FILINGS_PER_TYPE) -> DataFrame:
    """Filings with a valid accession number, the newest `limit` per ticker and type."""
    filings = files.filter(valid_accession(F.col("accession_number"))).select(*FILING_KEY).distinct()
    return latest(filings, ["ticker", "filing_type"], accession_order(F.col("accession_number")), limit)


def company_filings(
    files: DataFrame, companies: DataFrame, filing_types: list[str] | None = None, limit: int = FILINGS_PER_TYPE
) -> DataFrame:
    """`list_filings` for the companies of a dimension, with the company name.

    The tree has upper-case tickers, the dimension may not. The dimension has one row per
    ticker, so the join never multiplies; its size decides between broadcast and shuffle.
    """
    wanted = companies.select(F.upper("ticker").alias("ticker"), F.col("name").alias("company"))
    wanted = wanted.groupBy("ticker").agg(F.min("company").alias("company"))
    typed = files.filter(F.col("filing_type").isin(filing_types)) if filing_types else files
    # Other companies go before anything is ranked.
    return list_filings(typed.join(wanted.select("ticker"), "ticker", "left_semi"), limit).join(wanted, "ticker")


def pick_primary_document(files: DataFrame) -> DataFrame:
    """One document per filing: the first .htm/.html by name, else full-submission.txt, else no row."""
    # Tested on the path itself, so that the filter does not split it once more.
    low = F.lower("path")
    priority = F.when(low.endswith(".htm") | low.endswith(".html"), 0).when(
        F.endswith("path", F.lit("/full-submission.txt")), 1
    )
    ranked = files.withColumn("_p", priority).filter(F.col("_p").isNotNull())
    # A struct of strings is aggregated by sorting: the most selective key comes first.
    best = ranked.groupBy(*reversed(FILING_KEY)).agg(F.min(F.struct("_p", "path")).alias("best"))
    path = F.col("best.path")
    return best.select(*FILING_KEY, F.element_at(F.split(path, "/"), -1).alias("file_name"), path.alias("path"))


def read_documents(picks: DataFrame) -> DataFrame:
    """`picks` with the `text` of their document, invalid UTF-8 replaced.

    Only the picked files are opened: their paths are dealt over the tasks, and a task holds one file at a time.
    """
    schema = picks.schema.add("content", "binary")
    place = picks.columns.index("path")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, uri in enumerate(batch.column(place).to_pylist()):
                fs, path = open_uri(uri)
                with fs.open_input_stream(path) as source:
                    content = source.read()
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], schema.fieldNames())

    # Paths are a small table, and reading what they name is not. With a given number the partitions stay apart, whatever
    # the size of the paths; otherwise adaptive execution would merge them into one task.
    spark = picks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    opened = picks.repartition(tasks, "path").mapInArrow(read, schema)
    return opened.select(*picks.columns, valid_utf8(F.col("content")).alias("text"))
