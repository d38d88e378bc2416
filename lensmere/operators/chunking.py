"""Cutting documents into passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lensmere.functions import text as X
from lensmere.operators.running import running_count

# Fixed values: (token budget, overlapping words) per corpus, window sizes.
GENERAL_BUDGET, GENERAL_OVERLAP = 250, 50
COMPACT_BUDGET, COMPACT_OVERLAP = 220, 40
WINDOW_WORDS, SHORTEST_CHARS = 600, 100
CHARS_PER_TOKEN = 4
# Text ids are numbered in blocks of ids that begin alike.
ID_BEGINNING = 8


def budget_chunks(budget: int = GENERAL_BUDGET, overlap: int = GENERAL_OVERLAP):
    """Arrow function: text -> chunks of at most ``budget`` tokens.

    Each chunk after the first starts with the last ``overlap`` words of the
    one before and takes at least one new word.  Where a chunk ends depends on
    where it starts, so a document is walked chunk by chunk; the end of a chunk
    is found by binary search in the running word offsets.
    """
    if overlap >= budget:
        raise ValueError("the overlap must be smaller than the budget")
    room = CHARS_PER_TOKEN * (budget + 1)

    def spans(words: list) -> list:
        offsets = np.concatenate(
            [[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
        start, stop, out = 0, 0, []
        while stop < len(words):
            reach = int(np.searchsorted(offsets, offsets[start] + room, side="right")) - 1
            previous, stop = stop, max(stop + 1, reach)
            out.append((start, stop))
            start = stop - overlap if stop - start > overlap else start
        return out

    def cut(text: str | None) -> list:
        words = (text or "").split()
        if not words:
            return []
        if len(text) // CHARS_PER_TOKEN <= budget:
            return [text]
        return [" ".join(words[a:b]) for a, b in spans(words)]

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def chunks(texts: pa.Array) -> pa.Array:
        return pa.array([cut(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return chunks


def chunk_documents(docs: DataFrame, budget: int = GENERAL_BUDGET,
                    overlap: int = GENERAL_OVERLAP, at_least: int = 0) -> DataFrame:
    """One row per chunk with ``chunk_index`` and ``token_count``; other columns stay."""
    keep = [c for c in docs.columns if c != "text"]
    return docs.select(
        *keep, F.posexplode(budget_chunks(budget, overlap)(F.col("text"))).alias(
            "chunk_index", "text"),
    ).withColumn("token_count", X.token_estimate(F.col("text"), at_least))


def window_chunks(docs: DataFrame, size: int = WINDOW_WORDS,
                  shortest: int = SHORTEST_CHARS) -> DataFrame:
    """Fixed windows of words without overlap; short remainders are dropped."""
    keep = [c for c in docs.columns if c != "text"]
    by_word = docs.select(*keep, X.words(F.col("text")).alias("_w"))
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(1), F.size("_w"), F.lit(size)))
    return by_word.select("*", F.posexplode(starts).alias("chunk_index", "_s")).select(
        *keep, "chunk_index", F.array_join(F.slice("_w", F.col("_s"), size), " ").alias("text"),
        F.least(F.lit(size), F.size("_w") - F.col("_s") + 1).alias("token_count"),
    ).filter(F.length("text") >= shortest)


def number_chunks(chunks: DataFrame, prefix: str, digits: int,
                  block: Column | None = None) -> DataFrame:
    """Running ids in document and chunk order, e.g. ``chunk_000042``.

    Documents are numbered block by block, so no task sees all rows.  A block
    is a range of numeric ids, or the text ids with one beginning.
    """
    if block is None:
        textual = chunks.schema["doc_id"].dataType == T.StringType()
        block = F.substring("doc_id", 1, ID_BEGINNING) if textual else F.floor(
            F.col("doc_id") / 10_000)
    numbered = running_count(chunks, [], ["doc_id", "chunk_index"], block, "_no")
    number = (F.col("_no") - 1).cast("string")
    width = F.greatest(F.lit(digits), F.length(number))
    return numbered.withColumn(
        "id", F.concat(F.lit(prefix), F.lpad(number, width, F.lit("0")))).drop("_no")
