"""The last messages of every conversation, kept while they arrive.

The state of a conversation is its last ten messages, whatever its length. Each batch gives the conversations it
touched with their messages as they now are, and their profiles follow from those rows alone. Batches are written under their
number, so a batch that is run again replaces itself; `latest` reads the newest row of every conversation.

Defined results: as `last_n_messages` over all messages that have arrived, in any order of arrival; messages without a
conversation or a turn are left out; of equal turns the smaller (role, content) counts as older.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from filigree import rules as R

STATE = "turns array<bigint>, roles array<string>, contents array<string>"
OUTPUT = f"conv_id bigint, {STATE}"
BATCHES = f"{OUTPUT}, batch bigint"


def _order(message: tuple) -> tuple:
    turn, role, content = message
    return turn, role is not None, role or "", content is not None, content or ""


def last_messages_stream(messages: DataFrame, n: int = R.HISTORY_WINDOW) -> DataFrame:
    """A stream of (conv_id, turns, roles, contents): the last n messages, oldest first, of conversations with new ones."""
    def keep(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for frame in frames:
            # Values that are missing come as NaN or None.
            fresh = frame[["turn", "role", "content"]].astype(object).where(frame[["turn", "role", "content"]].notna(), None)
            held = sorted([*held, *fresh.itertuples(index=False, name=None)], key=_order)[-n:]
        columns = [list(column) for column in zip(*held)]
        state.update(tuple(columns))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [columns[0]], "roles": [columns[1]], "contents": [columns[2]]})

    rows = messages.select("conv_id", "turn", "role", "content").where("conv_id is not null and turn is not null")
    return rows.groupBy("conv_id").applyInPandasWithState(keep, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def history_stream(messages: DataFrame, path: str, checkpoint: str, n: int = R.HISTORY_WINDOW) -> None:
    """Take in what has arrived, then stop. The rows of each batch are written below `path`."""
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = last_messages_stream(messages, n).writeStream.outputMode("update").foreachBatch(store)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, turn, role, content): the messages that every conversation holds now."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("batch"))
    rows = spark.read.schema(BATCHES).parquet(path).withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    zipped = F.arrays_zip(F.col("turns").alias("turn"), F.col("roles").alias("role"), F.col("contents").alias("content"))
    return rows.select("conv_id", F.inline(zipped))
