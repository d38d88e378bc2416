"""The conversation store as a stream of events: create, append, rename, delete.

A conversation's state is kept by key across batches and holds its title and totals only, never its
messages; these stay where the events come from.  Every batch writes the states it changed under its own number,
deleted ones as tombstones, so a batch that is run again replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lensmere.functions import text as X
from lensmere.operators.conversation import DEFAULT_TITLE, RENAMED_TITLE_CHARS, TITLE_CHARS, UNTITLED

OUT = "conv_id long, title string, message_count long, updated long, deleted boolean"
STATE = "title string, message_count long, updated long, live boolean"


def applied(state: tuple, action: str, role: str | None, text: str | None, seq: int) -> tuple:
    """(title, messages, updated, live) after one event.

    A message brings a conversation to life, a rename does not; the first message of a user that is not
    blank gives an unnamed conversation its title.
    """
    title, count, updated, live = state
    text = text or ""
    if action == "delete":
        return DEFAULT_TITLE, 0, seq, False
    if action == "rename":
        return ((text or UNTITLED)[:RENAMED_TITLE_CHARS], count, seq, True) if live else state
    if not live:
        title, count = (text or DEFAULT_TITLE) if action == "create" else DEFAULT_TITLE, 0
    if action == "append":
        count += 1
        if role == "user" and title in ("", DEFAULT_TITLE) and text.strip():
            title = text.strip()[:TITLE_CHARS]
    return title, count, seq, True


def _keyed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(state.get) if state.exists else (DEFAULT_TITLE, 0, -1, False)
    # A batch's events of one conversation, texts already cut to what a title can take.
    events = pd.concat(list(frames)).sort_values(["seq", "action", "role", "text"], kind="stable", na_position="first")
    known = state.exists
    for e in events.itertuples(index=False):
        now = applied(now, e.action, e.role, e.text, int(e.seq))
    if known or now[2] >= 0:
        state.update(now)
        yield pd.DataFrame({"conv_id": [key[0]], "title": [now[0]], "message_count": [now[1]], "updated": [now[2]], "deleted": [not now[3]]})


def keep(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Follow a stream of (conv_id long, seq long, action, role, text).

    Events of one batch are applied in the order of ``seq``, batches as they come.  Changed states go to
    ``folder/state`` below the batch's number; messages stay where the events come from.
    """
    named = F.when(F.col("action") == "rename", F.col("text")).otherwise(X.trimmed(X.or_empty(F.col("text"))))
    cut = events.select("conv_id", "seq", "action", "role", F.substring(named, 1, RENAMED_TITLE_CHARS).alias("text"))
    states = cut.groupBy("conv_id").applyInPandasWithState(_keyed, OUT, STATE, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(
        write).trigger(availableNow=True).start()


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, title, message_count, updated) of the conversations that are not deleted."""
    rows = spark.read.schema(OUT + ", batch int").parquet(f"{folder}/state")
    latest = rows.groupBy("conv_id").agg(F.max_by(F.struct("title", "message_count", "updated", "deleted"), "batch").alias("s"))
    return latest.select("conv_id", "s.*").filter(~F.col("deleted")).drop("deleted")

