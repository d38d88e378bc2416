"""Exact search of all embeddings for every fiftieth of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lensmere.llm import topk_segments
from lensmere.tables import table


def search(spark: SparkSession, sf: str) -> DataFrame:
    rows = topk_segments.quantised(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return topk_segments.top_k(rows.where("vec_id % 50 = 0"), rows, 5)


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

REGISTRY = {"op9_exact_top_k": (search, SQL)}
