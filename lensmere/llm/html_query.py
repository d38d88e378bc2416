"""Main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lensmere.llm import html_main
from lensmere.tables import table


def main_text(spark: SparkSession, sf: str) -> DataFrame:
    out = html_main.extracted(table(spark, sf, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))


REGISTRY = {"op8_html_main_text": (main_text, None)}
