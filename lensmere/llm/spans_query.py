"""All documents without the passages that an earlier one holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lensmere.llm import spans
from lensmere.tables import table


def substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return spans.without_repeats(table(spark, sf, "documents").select("doc_id", "text"))


REGISTRY = {"op7_substring_dedup": (substring_dedup, None)}
