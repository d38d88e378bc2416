"""Encoding and decoding of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lensmere.llm import pieces
from lensmere.tables import table


def encode(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.digested(table(spark, sf, "documents").select("doc_id", "text"))


REGISTRY = {"op6_sentencepiece": (encode, None)}
