"""A collection of chunks: Parquet, partitioned by ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.schemas import COLLECTION
from filigree.session import materialize


def create_collection(spark: SparkSession, path: str) -> None:
    """An empty collection at the path; one that is there already stays as it is."""
    spark.createDataFrame([], COLLECTION).write.mode("ignore").partitionBy("ticker").parquet(path)


def open_collection(spark: SparkSession, path: str) -> DataFrame:
    """The collection at the path. Nothing is written: a path without one fails when it is read."""
    return spark.read.schema(COLLECTION).parquet(path)


def _by_id(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti-join on ticker and chunk id; null tickers are equal."""
    other = ids.select(F.col("ticker").alias("_ticker"), F.col("chunk_id").alias("_id"))
    return rows.join(other, F.col("ticker").eqNullSafe(F.col("_ticker")) & F.col("chunk_id").eqNullSafe(F.col("_id")), how)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Append the chunks whose id is not stored yet; a second run adds nothing.

    Ids are compared before any content is read: stored ids only in the partitions of the batch's tickers, and only rows
    with a new id go on, so a run that adds nothing moves nothing but ids. Of chunks with one id the content with
    the smallest hash is taken. Before the write, rows are rebalanced by ticker: small tickers share files, a
    ticker that holds much of the data is spread over tasks.
    """
    spark = chunks.sparkSession
    create_collection(spark, path)
    if "embedding" not in chunks.columns:
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    key = ["ticker", "chunk_id"]
    ids = materialize(chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")), "batch-ids")
    tickers = ids.select(F.col("ticker").alias("_ticker")).distinct()
    stored = open_collection(spark, path).select(*key).join(tickers, F.col("ticker").eqNullSafe(F.col("_ticker")), "left_semi")
    new = materialize(_by_id(ids, stored, "left_anti"), "new-ids")
    once = _by_id(chunks, new.where("rows = 1"), "left_semi")
    rest = [f.name for f in COLLECTION if f.name not in key]
    picked = F.min_by(F.struct(*rest), F.struct(F.xxhash64("content"), F.hash("content"))).alias("row")
    again = _by_id(chunks, new.where("rows > 1"), "left_semi").groupBy(*key).agg(picked).select(*key, "row.*")
    names = [f.name for f in COLLECTION]
    rows = once.select(*names).union(again.select(*names))
    rows.hint("rebalance", "ticker").write.mode("append").partitionBy("ticker").parquet(path)
