"""The mix of all documents by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lensmere.llm import mixing
from lensmere.tables import table


def mix(spark: SparkSession, sf: str) -> DataFrame:
    out = mixing.planned(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
                      (F.size("mix_copies") * F.col("mix_size")).alias("taken"))


REGISTRY = {"op3_source_mixing": (mix, None)}
