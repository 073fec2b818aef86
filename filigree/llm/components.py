"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return (
        both.join(least, F.col("u") == F.col("n")).where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
    moved = edges.join(least, F.col("u") == F.col("n")).where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node of its component) for every node that is not a root.

    `edges`: two columns of one orderable type, any direction, repeats allowed. The number of rounds
    grows with the logarithm of the longest chain. Every round is a table in the shared folder, minima
    are combined before their shuffle, and joins on a node of many edges can be split.
    """
    a, b = edges.columns[:2]
    table = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    table = materialize(table, "edges")
    mark = _mark(table)
    while mark[0]:
        table = materialize(_small_star(_large_star(table)), "edges")
        last, mark = mark, _mark(table)
        if last == mark:
            break
    return table.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of the edges; both stay the same only when a round changed nothing."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first()
    return tuple(row)
