"""A collection of chunks as a catalogue table, bucketed by chunk id.

Parquet files below a folder, partitioned by ticker and in every partition bucketed by chunk id. The table is
external: the folder keeps the data, and `open_table` registers it in the catalogue of a new session. A batch is dealt by the
same hash as the buckets, so the anti-join against the stored ids shuffles the batch alone and the stored side is read where
it lies, one task per bucket, as two columns.
"""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.schemas import COLLECTION
from filigree.session import materialize, open_uri

#: Buckets of a new table; a power of two near the number of cores keeps tasks of one size.
BUCKETS = 64


def open_table(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The table `name` over the folder; what is not there yet is created. `buckets` must be that of the first time."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in COLLECTION)
        spark.sql(f"create table {name} ({columns}) using parquet partitioned by (ticker) "
                  f"clustered by (chunk_id) sorted by (chunk_id) into {buckets} buckets location '{path}'")
        fs, place = open_uri(path)
        if fs.get_file_info(place).type == pafs.FileType.Directory:
            spark.catalog.recoverPartitions(name)
    return spark.table(name)


def new_rows(chunks: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows of a batch whose id is not in the table, one for each id, dealt by the table's buckets.

    Of rows with one id the content with the smallest hash is taken. Chunk ids hold the ticker and are never null.
    """
    spark = chunks.sparkSession
    if "embedding" not in chunks.columns:
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    dealt = chunks.select(*[f.name for f in COLLECTION]).repartition(buckets, "chunk_id")
    rest = F.struct(*[f.name for f in COLLECTION if f.name != "chunk_id"])
    unique = dealt.groupBy("chunk_id").agg(F.min_by(rest, F.struct(F.xxhash64("content"), F.hash("content"))).alias("row"))
    stored = spark.table(name).select("chunk_id")
    return unique.select("chunk_id", "row.*").join(stored.hint("merge"), "chunk_id", "left_anti").select(*[f.name for f in COLLECTION])


def append_new(chunks: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """Append what is not stored yet; a second run adds nothing."""
    rows = materialize(new_rows(chunks, name, buckets), "new-chunks")
    rows.repartition(buckets, "chunk_id").write.insertInto(name)
