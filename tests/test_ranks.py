"""Places in groups against plain sorting, with a group that spans many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from filigree.operators.ranks import numbered
from filigree.plans import standins as D


@pytest.mark.parametrize("parts", ["8", "40"])
def test_places_in_groups(spark, parts):
    draw = random.Random(1)
    rows = [(draw.choice([None, "a", "b", "hot", "hot", "hot"]), i) for i in range(2000)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "name string, n int").repartition(7)
        got = {(r.name, r.n): r.at for r in numbered(frame, "name", [F.col("n")], "at").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = {}
    for name, n in rows:
        groups.setdefault(name, []).append(n)
    assert got == {(name, n): at for name, found in groups.items() for at, n in enumerate(found)}
    assert numbered(frame.limit(0), "name", [F.col("n")]).count() == 0


def test_histories_with_gaps_and_long_conversations(spark, tmp_path):
    """Turns with gaps and beyond 100,000: each question keeps its own last ten messages and its reply."""
    rows = [(1, 100_000 * i, "user" if i % 2 == 0 else "assistant", f"one {i}") for i in range(30)]
    rows += [(2, i, "user", f"two {i}") for i in range(3)] + [(2, 7, "system", "no turn of the talk"), (2, 9, "assistant", "late reply"), (2, 10, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    requests, before = D.every_question(spark, str(tmp_path))
    answers = {r.query_id: (r.query, r.answer) for r in requests.collect()}
    assert len(answers) == 18 and answers["1-28"] == ("one 28", "one 29") and answers["2-2"] == ("two 2", "late reply") and answers["2-1"] == ("two 1", "")
    history = {}
    for r in before.orderBy("turn").collect():
        history.setdefault(r.conv_id, []).append(r.content)
    assert history["1-28"] == [f"one {i}" for i in range(18, 28)] and history["2-2"] == ["two 0", "two 1"] and "1-0" not in history
