"""Token counts of all documents before and after edits that their ids decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lensmere.llm import token_edits
from lensmere.tables import table


def own_edits() -> Column:
    """Three edits a document: words put in front, a passage replaced by another, words added at the end."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    place = F.pmod(F.xxhash64(F.lit(5), "doc_id"), n + 1)
    change = lambda start, stop, new: F.struct(start.alias("start"), stop.alias("stop"), new.alias("new"))
    return F.array(
        change(F.lit(0).cast("long"), F.lit(0).cast("long"), F.concat_ws(" ", F.lit("In"), "lang", F.lit(""))),
        change(place, place + 40, F.concat(F.coalesce("source", F.lit("")), F.lit("'ll"))),
        change(n + 1000, n + 1000, F.concat(F.lit("\n\n"), F.coalesce("source", F.lit("")))))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return token_edits.edited_counts(docs, own_edits())


REGISTRY = {"op5_token_counts": (counts, None)}
