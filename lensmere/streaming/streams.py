"""Streaming state: session counters, the audit log, incremental contexts.

Streams write to folders the caller names (on a cluster, below
``spark.checkpoint.dir`` or another shared folder).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lensmere.operators.corpus import new_rows
from lensmere.tables import exists


def count_sessions(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the number of queries per session.

    The count is a streaming aggregation, so it is combined before the shuffle
    and a very busy session sends one row per task and batch.  Each batch
    writes the changed totals under its own number; a batch that is run again
    after a failure replaces its own output.
    """
    totals = events.groupBy("session_id").agg(
        F.count("*").alias("queries"), F.max("ts").alias("last_seen"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return totals.writeStream.outputMode("update").option(
        "checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def session_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Latest total per session from the written batches."""
    rows = spark.read.parquet(folder)
    return rows.groupBy("session_id").agg(
        F.max_by("queries", "batch").alias("queries"), F.max("last_seen").alias("last_seen"))


def audit_records(events: DataFrame, kind: Column, ts: Column, payload: Column) -> DataFrame:
    """Audit rows: event, ts, payload as JSON text, and the day for the folder."""
    return events.select(kind.alias("event"), ts.alias("ts"), F.to_json(payload).alias("payload"),
                         F.to_date(ts).alias("day"))


def append_audit(records: DataFrame, folder: str, checkpoint: str,
                 rows_per_file: int = 100_000) -> StreamingQuery:
    """Append audit rows as JSON lines; files roll over by size and day."""
    return records.writeStream.format("json").outputMode("append").partitionBy("day").option(
        "path", folder).option("checkpointLocation", checkpoint).option(
        "maxRecordsPerFile", rows_per_file).trigger(availableNow=True).start()


def add_contexts(chunks: DataFrame, generate: Callable[[Column], Column], folder: str,
                 checkpoint: str) -> StreamingQuery:
    """Generate a context for every chunk that has none yet.

    Batches are written under their number; chunks already present in earlier
    output are left out, so the job can be stopped and started at any time.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        todo = batch.select("id", "text")
        if exists(spark, f"{folder}/batch=*"):
            todo = new_rows(todo, spark.read.parquet(folder).filter(F.col("batch") < number))
        todo.select("id", generate(F.col("text")).alias("ctx")).write.mode(
            "overwrite").parquet(f"{folder}/batch={number}")

    return chunks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        write).trigger(availableNow=True).start()


def dialogue_frames(replies: DataFrame) -> DataFrame:
    """(reply_id, position, event, data): the frames a client of a reply would see.

    One token frame per word, then a done frame with the whole text.
    """
    words = F.split("text", " ")
    tokens = replies.select("reply_id", F.posexplode(words).alias("position", "w")).select(
        "reply_id", "position", F.lit("token").alias("event"),
        F.when(F.col("position") == 0, F.col("w")).otherwise(F.concat(F.lit(" "), "w"))
        .alias("data"))
    done = replies.select(
        "reply_id", F.size(words).alias("position"), F.lit("done").alias("event"),
        F.col("text").alias("data"))
    return tokens.unionByName(done)
