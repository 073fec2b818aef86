"""Histories kept by a stream of many batches against the batch operators over all messages."""

import random

import pytest
from pyspark.sql import functions as F

from filigree.operators.conversation import history_profile, last_n_messages
from filigree.plans.registry import REGISTRY
from filigree.rules import FollowupRules
from filigree.streaming.history_stream import history_stream, latest

MESSAGES = "conv_id bigint, turn bigint, role string, content string"


@pytest.mark.parametrize("order", ["in turn", "mixed"])
def test_many_batches_equal_the_whole(spark, tmp_path, order):
    draw = random.Random(4)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t} {draw.choice(['revenue', 'risk factors', 'apple', 'x'])}") for c in range(6) for t in range(4 + 9 * (c % 3))]
    rows += [(9, 2**60, "user", None), (9, 2**60 + 1, None, "kept"), (None, 1, "user", "nowhere"), (9, None, "user", "no turn")]
    if order == "mixed":
        draw.shuffle(rows)
    source, path, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for i in range(0, len(rows), 23):
        spark.createDataFrame(rows[i:i + 23], MESSAGES).coalesce(1).write.mode("append").parquet(source)
        if i % 46 == 0:
            stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(source)
            history_stream(stream, path, state)
    history_stream(spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(source), path, state)
    every = spark.createDataFrame([r for r in rows if r[0] is not None and r[1] is not None], MESSAGES)
    found = latest(spark, path)
    wanted = last_n_messages(every, 10).select("conv_id", "turn", "role", "content")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
    profiles = [history_profile(m, FollowupRules()).orderBy("conv_id").collect() for m in (found, every)]
    assert profiles[0] == profiles[1] and len(profiles[0]) == 7
    assert spark.read.parquet(path).select(F.max(F.size("turns"))).first()[0] == 10


@pytest.mark.parametrize("name", ["history_stream", "ingest_stream"])
def test_tables_that_are_folders(spark, sf_dir, tmp_path, name):
    """A table of many files gives the rows of the table in one file."""
    for table in ("conversations", "documents"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(5).write.parquet(str(tmp_path / f"{table}.parquet"))
    found, wanted = (REGISTRY[name](spark, str(place)) for place in (tmp_path, sf_dir))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect())) and wanted.count()
