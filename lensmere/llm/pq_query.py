"""Near-duplicate groups of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lensmere.llm import pq
from lensmere.tables import table


def near(spark: SparkSession, sf: str) -> DataFrame:
    out = pq.near_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


SQL = """WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id
  AND list_cosine_similarity(p.e, q.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, m.b AS component_id, d.vec_id = m.b AS kept
FROM embeddings d LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = d.vec_id
JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.vec_id"""

REGISTRY = {"op4_pq_near_dedup": (near, SQL)}
