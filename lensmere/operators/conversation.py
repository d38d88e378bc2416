"""Conversations as an append-only message log.

State (titles, counts, deletions) is a view over the log, so concurrent
appends cannot overwrite each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lensmere.functions import lexicons as L
from lensmere.functions import text as X
from lensmere.operators.running import last_before

# Memory and follow-up limits.
MEMORY_TURNS, MEMORY_CHARS = 4, 800
TURN_CHARS_MIN, TURN_CHARS_MAX = 80, 220
FOLLOW_UP_WORDS, FOLLOW_UP_CHARS = 8, 300
TITLE_CHARS, RENAMED_TITLE_CHARS = 60, 80
DEFAULT_TITLE, UNTITLED = "New chat", "Untitled"

BLOCK_TURNS = 4096


def context_messages(log: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content) with the role defaulted."""
    return log.filter(F.col("text").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"),
        F.col("text").alias("content"))


def recent(log: DataFrame, turns: int = MEMORY_TURNS) -> DataFrame:
    """The last messages of each conversation; the limit applies before the shuffle."""
    back = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return log.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= turns)


def memory(log: DataFrame, turns: int = MEMORY_TURNS, chars: int = MEMORY_CHARS,
           current: DataFrame | None = None) -> DataFrame:
    """(conv_id, memory): a compact account of the last messages.

    ``current`` (conv_id, text) names the message being answered, which is
    left out when it is among them.
    """
    per_turn = max(TURN_CHARS_MIN, min(TURN_CHARS_MAX, chars // max(1, turns)))
    last = recent(log, turns)
    if current is not None:
        now = current.select("conv_id", X.trimmed("text").alias("now"))
        last = last.join(now, "conv_id", "left").filter(
            ~((F.col("role") == "user") & (X.trimmed("text") == F.coalesce("now", F.lit("")))))
    said = last.withColumn("said", X.squeezed(X.or_empty(F.col("text")))).filter("said <> ''")
    label = F.when(F.col("role") == "user", L.USER_LABEL).otherwise(L.ASSISTANT_LABEL)
    line = F.concat(label, F.lit(": "), X.shortened(F.col("said"), per_turn))
    # At most ``turns`` short lines per conversation are gathered.
    joined = said.select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"]), "\n",
        ).alias("text"))
    tail = F.right("text", F.lit(chars))
    cut = F.when(
        F.contains(tail, F.lit("\n")), F.regexp_replace(tail, r"^[^\n]*\n", "")).otherwise(tail)
    return joined.select("conv_id", F.when(F.length("text") > chars, cut).otherwise(
        F.col("text")).alias("memory"))


def previous_text(log: DataFrame, role: str, name: str) -> DataFrame:
    """The last earlier message of a role, next to every message."""
    return last_before(
        log, ["conv_id"], ["turn"], F.floor(F.col("turn") / BLOCK_TURNS),
        F.when(F.col("role") == role, F.col("text")), name)


def fold_follow_ups(log: DataFrame) -> DataFrame:
    """Short user messages with the user's previous message in front."""
    both = previous_text(log, "user", "earlier").filter(F.col("role") == "user")
    folded = X.trimmed(F.concat(
        F.substring("earlier", 1, FOLLOW_UP_CHARS), F.lit("\n"), F.col("text")))
    short = (X.word_count(F.col("text")) < FOLLOW_UP_WORDS) & F.col("earlier").isNotNull()
    return both.select(
        "conv_id", "turn", F.when(short, folded).otherwise(F.col("text")).alias("query"))


def listing(log: DataFrame) -> DataFrame:
    """(conv_id, title, last_turn, message_count), latest first."""
    blank = X.trimmed("text") == ""
    first_user = F.min_by(
        F.substring(X.trimmed("text"), 1, TITLE_CHARS), F.when((F.col("role") == "user") & ~blank, F.col("turn")))
    return log.groupBy("conv_id").agg(
        F.coalesce(first_user, F.lit(DEFAULT_TITLE)).alias("title"),
        F.max("turn").alias("last_turn"), F.count("*").alias("message_count"),
    ).orderBy(F.col("last_turn").desc(), "conv_id")


def current_state(events: DataFrame) -> DataFrame:
    """Titles after renames, without deleted conversations.

    ``events``: (conv_id, seq, action, payload) with action create, append,
    rename or delete; the last event of a kind wins.
    """
    def latest(action: str, value: Column) -> Column:
        return F.max_by(value, F.when(F.col("action") == action, F.col("seq")))

    renamed = F.substring(
        F.coalesce(X.non_empty(F.col("payload")), F.lit(UNTITLED)), 1, RENAMED_TITLE_CHARS)
    first = F.min_by(X.trimmed("payload"), F.when(F.col("action") == "append", F.col("seq")))
    state = events.groupBy("conv_id").agg(
        F.coalesce(latest("rename", renamed), F.substring(first, 1, TITLE_CHARS),
                   F.lit(DEFAULT_TITLE)).alias("title"),
        F.count_if(F.col("action") == "append").alias("message_count"),
        F.max("seq").alias("updated"),
        F.coalesce(F.max(F.when(F.col("action") == "delete", F.col("seq"))),
                   F.lit(-1)).alias("deleted"),
    )
    return state.filter(F.col("deleted") < F.col("updated")).drop("deleted")
