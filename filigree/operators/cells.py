"""Exact nearest chunks from an index of vectors in cells.

The vectors are stored as unit vectors, partitioned by the cell of their nearest centre. Centres come from k-means over a
bounded sample (`SAMPLE` vectors, by a hash of their ids); every vector is in the index. A cell's radius is the greatest
distance of its vectors to its centre, so by the triangle inequality no vector of a cell is nearer to a request than the
request's distance to the centre less the radius.

A search goes through the cells of each request in the order of that bound, as `filigree.operators.parts` states, so the
hits are those of a scan of the whole corpus, while cells that hold no hit are never read.

Defined results: as `knn_search`; vectors with null or NaN elements are not stored, zero vectors have a cell of their own, to
which every request has the distance of an orthogonal vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.operators.parts import SLACK, best_first
from filigree.operators.retrieval import _with_payload
from filigree.operators.topk import VectorScorer, _matrix
from filigree.session import materialize

#: Vectors the centres are found from, most centres, and steps of k-means.
SAMPLE, MOST_CELLS, STEPS = 20_000, 1_024, 12
#: What sums of floats can hide of a distance.
FLOAT_SLACK = 1e-6
ZERO_CELL = -1


@dataclass(frozen=True)
class VectorCells:
    """`vectors`: part (the cell), chunk_id, ticker, embedding (of length 1), distance to the centre. `centres`: a row per cell from 0 on."""

    path: str
    vectors: DataFrame
    centres: np.ndarray
    radii: dict[int, float]

    def __len__(self) -> int:
        return len(self.radii)


def find_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's k-means over unit vectors; the first centres are spread by greatest distance."""
    centres = [sample[0]]
    nearest = np.linalg.norm(sample - sample[0], axis=1)
    while len(centres) < cells and nearest.max() > 0:
        centres.append(sample[int(nearest.argmax())])
        nearest = np.minimum(nearest, np.linalg.norm(sample - centres[-1], axis=1))
    found = np.array(centres)
    for _ in range(STEPS):
        own = nearest_centre(sample, found)[0]
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=len(found))[:, None]
        found = np.where(counts > 0, sums / np.maximum(counts, 1), found)
    return found


def distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(axis=1)[:, None] - 2 * vectors @ centres.T + (centres**2).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares, 0))


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = distances(vectors, centres)
    own = found.argmin(axis=1)
    return own, found[np.arange(len(own)), own]


def _usable(vectors: DataFrame) -> DataFrame:
    """Vectors without null and NaN elements."""
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")))
    return vectors.where(F.col("embedding").isNotNull() & ~broken)


def build_cells(vectors: DataFrame, path: str, cells: int | None = None) -> VectorCells:
    """Write the index of `vectors` (chunk_id, ticker, embedding) to a new folder."""
    spark = vectors.sparkSession
    rows = _usable(vectors.select("chunk_id", "ticker", "embedding"))
    order = [F.xxhash64("chunk_id"), F.col("chunk_id"), F.xxhash64("embedding")]
    sample = rows.orderBy(*order).limit(SAMPLE).select("embedding").toPandas()["embedding"]
    width = len(sample.iloc[0]) if len(sample) else 0
    if cells is None:
        cells = min(MOST_CELLS, math.isqrt(rows.count()) + 1)
    units = _matrix(pa.array(sample.tolist(), pa.list_(pa.float64())), width) if width else np.zeros((0, 0))
    units = units[np.linalg.norm(units, axis=1) > 0]
    centres = find_centres(units, cells) if len(units) else np.zeros((0, width))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "part int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    rows.select("chunk_id", "ticker").limit(0).write.parquet(f"{path}/kinds")
    append_vectors(rows, path)
    return open_cells(spark, path)


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Add vectors to the index; centres stay, radii follow from what is stored."""
    centres = _centres(vectors.sparkSession, path)
    kinds = {f.name: f.dataType for f in vectors.schema}

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _matrix(batch.column("embedding"), len(batch.column("embedding")[0]))
            if len(centres):
                own, far = nearest_centre(units, centres)
            else:
                own, far = np.full(len(units), ZERO_CELL), np.zeros(len(units))
            zero = np.linalg.norm(units, axis=1) == 0
            own, far = np.where(zero, ZERO_CELL, own), np.where(zero, 0.0, far)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1) * units.shape[1], pa.int32()), pa.array(units.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), batch.column("ticker"), flat, pa.array(far), pa.array(own.astype(np.int64))],
                ["chunk_id", "ticker", "embedding", "distance", "part"])

    schema = T.StructType([
        T.StructField("chunk_id", kinds["chunk_id"]), T.StructField("ticker", kinds["ticker"]), T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("distance", T.DoubleType()), T.StructField("part", T.LongType())])
    placed = _usable(vectors.select("chunk_id", "ticker", "embedding")).mapInArrow(place, schema)
    placed.hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(f"{path}/vectors")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("part").collect()
    return np.array([r.centre for r in rows]) if rows else np.zeros((0, 0))


def open_cells(spark: SparkSession, path: str) -> VectorCells:
    """The index of a folder. Centres and radii, at most MOST_CELLS rows, are read at once."""
    path = path.rstrip("/")
    ids = spark.read.parquet(f"{path}/kinds").schema
    stored = T.StructType([*ids, T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("distance", T.DoubleType()),
                           T.StructField("part", T.LongType())])
    vectors = spark.read.schema(stored).parquet(f"{path}/vectors")
    radii = {r.part: r.radius for r in vectors.groupBy("part").agg(F.max("distance").alias("radius")).collect()}
    return VectorCells(path, vectors, _centres(spark, path), radii)


def least_distances(units: np.ndarray, index_centres: np.ndarray, radii: dict[int, float], cells: np.ndarray) -> np.ndarray:
    """The least distance of anything in a cell to each request."""
    far = np.zeros((len(units), len(cells)))
    real = cells != ZERO_CELL
    if real.any():
        far[:, real] = distances(units, index_centres[cells[real]]) - np.array([radii[c] for c in cells[real].tolist()])
    far[:, ~real] = math.sqrt(2)
    far[np.linalg.norm(units, axis=1) == 0] = 0.0  # a zero request is equally far from everything
    return far


def cell_order(units: np.ndarray, index_centres: np.ndarray, radii: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each request by rising least distance of anything in them, and these distances."""
    cells = np.array(sorted(radii), np.int64)
    far = least_distances(units, index_centres, radii, cells)
    order = np.argsort(far, axis=1, kind="stable")
    return cells[order], np.take_along_axis(far, order, axis=1)


def search_cells(index: VectorCells, requests: DataFrame, k: int = 3) -> tuple[DataFrame, list[dict[str, int]]]:
    """(query_id, chunk_id, ticker, score, rank), and for each round the cells read and the pairs of request and cell."""
    asked = materialize(_usable(requests.select("query_id", "companies", "embedding")), "requests")

    def pairs(kth: DataFrame | None, start: int, stop: int) -> DataFrame:
        todo = asked.withColumn("kth", F.lit(None).cast("double")) if kth is None else asked.join(kth, "query_id", "left")
        return _pairs(todo, index, start, stop)

    centres, radii = index.centres, index.radii

    def within(requests: pa.Table, rows: pa.Table, place: np.ndarray, parts: list[int], kth: np.ndarray) -> np.ndarray:
        units = _units(requests["embedding"].combine_chunks())
        return least_distances(units, centres, radii, np.array(parts, np.int64)) <= _reach(kth)[:, None]

    corpus = index.vectors.select("chunk_id", "ticker", "embedding", "part")
    rows = lambda parts: corpus.where(F.col("part").isin(parts))
    return best_first(rows, asked, pairs, lambda todo, start: _reached(todo, index, start), within, len(index), VectorScorer, k)


def _units(vectors: pa.Array) -> np.ndarray:
    return _matrix(vectors, len(vectors[0]))


def _reach(kth: np.ndarray) -> np.ndarray:
    """The greatest distance of a hit that is no worse than the k-th; anything, where there is none."""
    some = kth >= -2  # not NaN, and no mark for a missing score
    return np.where(some, np.sqrt(np.maximum(0, 2 - 2 * (np.where(some, kth, 0.0) - SLACK))) + FLOAT_SLACK, np.inf)


def _reached(todo: DataFrame, index: VectorCells, start: int) -> DataFrame:
    """(part, pairs, fresh): how many requests reach a cell, and for how many it comes after the first `start` ones."""
    centres, radii = index.centres, index.radii
    cells = np.array(sorted(radii), np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, fresh = np.zeros(len(cells), np.int64), np.zeros(len(cells), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                order, far = cell_order(_units(part.column("embedding")), centres, radii)
                reached = far <= _reach(part.column("kth").to_numpy(zero_copy_only=False).astype(float))[:, None]
                pairs += np.bincount(np.searchsorted(cells, order[reached]), minlength=len(cells))
                fresh += np.bincount(np.searchsorted(cells, order[:, start:][reached[:, start:]]), minlength=len(cells))
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(pairs), pa.array(fresh)], ["part", "pairs", "fresh"])

    return todo.select("embedding", "kth").mapInArrow(run, "part bigint, pairs bigint, fresh bigint")


def _pairs(todo: DataFrame, index: VectorCells, start: int, stop: int) -> DataFrame:
    """(query_id, companies, embedding, part): the cells from place `start` to `stop` that can hold a hit of a request."""
    centres, radii = index.centres, index.radii

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cells, far = cell_order(_units(part.column("embedding")), centres, radii)
                kth = part.column("kth").to_numpy(zero_copy_only=False).astype(float)
                reach = _reach(kth)
                # Nothing after the first cell out of reach is asked for, as the bounds rise.
                line, place = np.nonzero(far[:, start:stop] <= reach[:, None])
                rows = part.select(["query_id", "companies", "embedding"]).take(pa.array(line))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells[line, place + start].astype(np.int64))],
                                                 ["query_id", "companies", "embedding", "part"])

    fields = {f.name: f for f in todo.schema}
    schema = T.StructType([fields["query_id"], fields["companies"], fields["embedding"], T.StructField("part", T.LongType())])
    return todo.select("query_id", "companies", "embedding", "kth").mapInArrow(run, schema)


def knn_clustered(index: VectorCells, requests: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """The rows of `knn_search` from the index; `chunks` has the columns to be fetched for the hits."""
    return _with_payload(search_cells(index, requests, k)[0], chunks)
