"""Comparing search conditions on questions whose passage is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lensmere.operators import dense, evaluation, fusion
from lensmere.operators.models import Embedder, Reranker

CONDITIONS = ["dense_raw", "dense_rr", "hybrid_raw", "hybrid_rr"]


def runs(queries: DataFrame, docs: DataFrame, embedder: Embedder, reranker: Reranker,
         k: int = evaluation.CUTOFF) -> DataFrame:
    """(condition, query_id, doc_id, rank): dense and hybrid, before and after reranking.

    The order before and after reranking comes from one pass over each arm.
    """
    vectors = docs.select("doc_id", embedder(F.col("text")).alias("embedding"))
    dense_hits = dense.search(
        queries.select("query_id", embedder(F.col("text")).alias("embedding")), vectors,
        fusion.RERANK_POOL)
    pool = fusion.hybrid(queries, docs, embedder, k, pool_size=fusion.RERANK_POOL, embedded=vectors)
    arms = {
        "dense": fusion.rerank(dense_hits, queries, docs, reranker, skip_at=fusion.RERANK_SKIP),
        "hybrid": fusion.rerank(pool, queries, docs, reranker),
    }

    def both(name: str) -> DataFrame:
        conditions = F.array(
            F.struct(F.lit(f"{name}_raw").alias("condition"), F.col("rank").alias("rank")),
            F.struct(F.lit(f"{name}_rr").alias("condition"), F.col("final_rank").alias("rank")))
        return arms[name].select("query_id", "doc_id", F.explode(conditions).alias("c")).select(
            "c.condition", "query_id", "doc_id", "c.rank").filter(F.col("rank") <= k)

    return both("dense").unionByName(both("hybrid"))


def gold_ranks(queries: DataFrame, gold: DataFrame, docs: DataFrame, embedder: Embedder,
               reranker: Reranker, k: int = evaluation.CUTOFF) -> DataFrame:
    """Place of the known passage per condition and query."""
    return evaluation.gold_ranks(gold, runs(queries, docs, embedder, reranker, k), CONDITIONS)
