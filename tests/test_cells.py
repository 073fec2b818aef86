"""The clustered vector index against brute force, and what it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.operators import cells as M
from filigree.operators import retrieval as Q
from filigree.session import scratch_path
from test_retrieval import brute_vectors, vectors

VECTORS = "chunk_id long, ticker string, embedding array<float>"
REQUESTS = "query_id long, companies array<string>, embedding array<float>"


def hits(frame):
    got = {}
    for row in frame.orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.chunk_id)
        assert row.rank == len(got[row.query_id])
    return got


@pytest.mark.parametrize(("k", "cells"), [(1, 1), (4, 7), (20, None), (60, 5)])
def test_hits_equal_brute_force(spark, k, cells):
    corpus = vectors()
    requests = [(i, [None, [], ["T0"], ["T1", "T2"], ["none"]][i % 5], corpus[i][2]) for i in range(11)] + [(50, None, [0.0] * 4)]
    frame = spark.createDataFrame(corpus, VECTORS).repartition(5)
    odd = spark.createDataFrame([(500, "T0", None), (501, "T0", [1.0, None, 0.0, 0.0]), (502, "T0", [float("nan")] * 4)], VECTORS)
    frame = frame.unionByName(odd)
    asked = spark.createDataFrame([*requests, (90, None, None)], REQUESTS)
    index = M.build_cells(frame, scratch_path(spark, "cells"), cells)
    got = hits(M.knn_clustered(index, asked, frame, k))
    assert got == {q: ids for q, ids in brute_vectors(corpus, requests, k).items() if ids}
    assert got == hits(Q.knn_search(frame, asked, k))


def test_cells_without_a_hit_are_not_read(spark):
    """Forty groups far from each other: a request reads its own group's cell and few more, whatever the others hold."""
    rng = np.random.default_rng(3)
    groups = rng.normal(size=(40, 16))
    corpus = [(i, f"T{i % 4}", (groups[i % 40] + rng.normal(size=16) * 0.02).tolist()) for i in range(4000)]
    frame = spark.createDataFrame(corpus, VECTORS)
    asked = spark.createDataFrame([(i, None, corpus[i][2]) for i in range(3)], REQUESTS)
    index = M.build_cells(frame, scratch_path(spark, "cells"), 40)
    found, rounds = M.search_cells(index, asked, 5)
    assert hits(found) == hits(Q.knn_search(frame, asked, 5))
    assert len(index) == 40 and sum(r["pairs"] for r in rounds) <= 3 * 5 and rounds[0] == {"parts": 3, "pairs": 3}
    files = index.vectors.where(F.col("part").isin([0, 1])).select(F.input_file_name()).distinct().collect()
    assert all("/part=0/" in f[0] or "/part=1/" in f[0] for f in files)


def test_vectors_can_be_added_later(spark):
    corpus = vectors()
    path = scratch_path(spark, "cells")
    M.build_cells(spark.createDataFrame(corpus[:20], VECTORS), path, 4)
    M.append_vectors(spark.createDataFrame(corpus[20:], VECTORS), path)
    requests = [(i, None, corpus[i][2]) for i in range(0, 40, 3)]
    found, _ = M.search_cells(M.open_cells(spark, path), spark.createDataFrame(requests, REQUESTS), 6)
    assert hits(found) == brute_vectors(corpus, requests, 6)


def test_empty_index_and_no_requests(spark):
    empty = spark.createDataFrame([], VECTORS)
    asked = spark.createDataFrame([(1, None, [1.0, 0.0])], REQUESTS)
    index = M.build_cells(empty, scratch_path(spark, "cells"))
    assert M.knn_clustered(index, asked, empty).count() == 0
    frame = spark.createDataFrame([(1, "T", [1.0, 0.0])], VECTORS)
    index = M.build_cells(frame, scratch_path(spark, "cells"))
    assert M.knn_clustered(index, asked.limit(0), frame).count() == 0
    assert hits(M.knn_clustered(index, asked, frame)) == {1: [1]}
    assert sorted(index.radii) == [0]


def test_no_row_is_written_for_a_pair(spark, monkeypatch):
    """Vectors without groups: requests reach nearly all cells, but are written for the first five only."""
    from filigree.operators import parts
    folders = []
    monkeypatch.setattr(parts, "scratch_path", lambda spark, name: folders.append(scratch_path(spark, name)) or folders[-1])
    rng = np.random.default_rng(8)
    frame = spark.createDataFrame([(i, f"T{i % 4}", rng.normal(size=16).tolist()) for i in range(600)], VECTORS)
    asked = frame.selectExpr("chunk_id as query_id", "if(chunk_id % 2 = 0, array('T1', 'T2'), null) as companies", "embedding").where("query_id < 60")
    index = M.build_cells(frame, scratch_path(spark, "cells"), 24)
    found, rounds = M.search_cells(index, asked, 3)
    assert hits(found) == hits(Q.knn_search(frame, asked, 3))
    assert rounds[-1]["pairs"] > 5 * 60
    assert sum(spark.read.parquet(f).count() for f in folders if "asked-parts" in f) <= 5 * 60
