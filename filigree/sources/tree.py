"""The filing tree as a data source, listed by tasks.

`spark.read.format("filing_tree")` and `spark.readStream.format("filing_tree")` give a row for every file
`<root>/sec-edgar-filings/<TICKER>/<type>/<accession>/<file>`. The driver lists tickers only; each task lists the folders
of its tickers and opens no file. A stream reads what was modified after the last batch and up to `settleSeconds`
(default 1) before now, so that a later batch takes what is still being written.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from filigree.session import open_uri

SCHEMA = "path string, ticker string, filing_type string, accession_number string, file_name string, modified timestamp"
FOLDER = "sec-edgar-filings"
#: Tasks of a listing at most; more tickers share them.
MOST_TASKS = 2_000
#: Rows of a batch.
BATCH = 10_000


@dataclass
class Tickers(InputPartition):
    """Tickers to list, and the range of modification times (nanoseconds) that counts."""

    names: list[str]
    after: int
    until: int


def _folder(root: str) -> tuple[pafs.FileSystem, str]:
    fs, place = open_uri(f"{root.rstrip('/')}/{FOLDER}")
    return fs, place


def ticker_tasks(root: str, after: int, until: int) -> list[Tickers]:
    """The tickers of the tree dealt over tasks. A tree that is not there yet has none."""
    fs, place = _folder(root)
    found = fs.get_file_info(pafs.FileSelector(place, allow_not_found=True))
    names = sorted(entry.base_name for entry in found if entry.type == pafs.FileType.Directory)
    n = min(MOST_TASKS, len(names))
    return [Tickers(names[i::n], after, until) for i in range(n)]


def list_tickers(root: str, part: Tickers) -> Iterator[pa.RecordBatch]:
    fs, place = _folder(root)
    for name in part.names:
        rows = []
        for entry in fs.get_file_info(pafs.FileSelector(f"{place}/{name}", recursive=True, allow_not_found=True)):
            inner = entry.path[len(place) + 1:].split("/")
            if entry.type == pafs.FileType.File and len(inner) == 4 and part.after < (entry.mtime_ns or 0) <= part.until:
                rows.append((f"{root.rstrip('/')}/{FOLDER}/{'/'.join(inner)}", *inner, (entry.mtime_ns or 0) // 1000))
        for at in range(0, len(rows), BATCH):
            columns = list(zip(*rows[at:at + BATCH]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.string()) for c in columns[:-1]), pa.array(columns[-1], pa.timestamp("us", "UTC"))],
                ["path", "ticker", "filing_type", "accession_number", "file_name", "modified"])


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Tickers]:
        return ticker_tasks(self.root, -1, 1 << 62) or [Tickers([], 0, 0)]

    def read(self, partition: Tickers) -> Iterator[pa.RecordBatch]:
        yield from list_tickers(self.root, partition)


class TreeStreamReader(DataSourceStreamReader):
    """Offsets are modification times."""

    def __init__(self, root: str, settle: float):
        self.root, self.settle = root, settle

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Tickers]:
        return ticker_tasks(self.root, start["until"], end["until"]) or [Tickers([], 0, 0)]

    def read(self, partition: Tickers) -> Iterator[pa.RecordBatch]:
        yield from list_tickers(self.root, partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch that is done."""


class FilingTree(DataSource):
    """Options: `root`, and for streams `settleSeconds`."""

    @classmethod
    def name(cls) -> str:
        return "filing_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options["root"])

    def streamReader(self, schema: StructType) -> TreeStreamReader:  # noqa: N802
        return TreeStreamReader(self.options["root"], float(self.options.get("settleSeconds", "1")))


def filing_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files of the tree below a root folder."""
    spark.dataSource.register(FilingTree)
    return spark.read.format("filing_tree").option("root", root).load()


def filing_tree_stream(spark: SparkSession, root: str, settle: float = 1) -> DataFrame:
    """A stream of the files of the tree; new filings of new and of known tickers come with later batches."""
    spark.dataSource.register(FilingTree)
    return spark.readStream.format("filing_tree").option("root", root).option("settleSeconds", str(settle)).load()
