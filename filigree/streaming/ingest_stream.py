"""New documents to a collection with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from filigree import rules as R
from filigree.operators.chunks import process_filing
from filigree.sources.collection import write_chunks


def read_document_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet",
                         files_per_batch: int = 1000) -> DataFrame:
    """A file stream over Parquet documents: the files of a folder that fit `glob`.

    `path` may be a pattern of files and folders, as `/in/documents[.]parquet` for a table that is one or the other: a
    stream does not open a single file by its plain name, and `glob` is held against names of files alone.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_stream(documents: DataFrame, collection: str, checkpoint: str,
                  targets: dict[str, str] | None = R.TARGET_SECTIONS) -> None:
    """Process what has arrived, then stop.

    Each batch goes through the idempotent `write_chunks`: repeats within a batch, across
    batches and after a retry are dropped against the stored ids, so the stream keeps no state
    that would grow with the collection.
    """
    def store(batch: DataFrame, _: int) -> None:
        write_chunks(process_filing(batch, targets), collection)

    stream = documents.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    query = stream.trigger(availableNow=True).start()
    query.awaitTermination()
