"""Reciprocal rank fusion, hybrid search and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lensmere.operators import dense, lexical
from lensmere.operators.models import Embedder, Reranker
from lensmere.operators.pools import join_pool

# Fusion constant, pool sizes, rerank settings.
RRF_K = 60
POOL = 50
RERANK_POOL = 50
RERANK_SKIP = 0.86


def reciprocal_rank_fusion(lists: list, k: int = RRF_K) -> DataFrame:
    """Fuse (query_id, doc_id, rank, score) lists.

    Equal scores keep the order of first appearance: earlier list, then rank.
    ``first_list_score`` is the score a document had in the first list, so the
    first list need not be joined back.
    """
    tagged = None
    for number, one in enumerate(lists):
        part = one.select("query_id", "doc_id", "rank", F.lit(number).alias("list_no"),
                          F.when(F.lit(number == 0), F.col("score")).alias("first"))
        tagged = part if tagged is None else tagged.unionByName(part)
    # One shuffle serves the sums and their order.  It also keeps Spark 4.1 from taking the lists' own partitioning for
    # that of their union, which does not hold once the lists' shuffles are coalesced.
    fused = tagged.repartition("query_id").groupBy("query_id", "doc_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("score"),
        F.min(F.struct("list_no", "rank")).alias("first_seen"),
        F.max("first").alias("first_list_score"),
    )
    order = W.partitionBy("query_id").orderBy(
        F.col("score").desc(), F.col("first_seen").asc(), F.col("doc_id").asc())
    return fused.select(
        "query_id", "doc_id", "score", F.row_number().over(order).alias("rank"),
        "first_list_score")


def hybrid(queries: DataFrame, docs: DataFrame, embedder: Embedder, k: int = 10,
           pool: int = POOL, pool_size: int | None = None,
           excluded: list | None = None, min_score: float | None = None,
           embedded: DataFrame | None = None, sparse: DataFrame | None = None) -> DataFrame:
    """Dense and lexical search fused per query.

    ``embedded`` and ``sparse`` stand for stored vectors and for the hits of a
    stored lexical index; with both, the texts are not read.

    ``queries``: (query_id, text); ``docs``: (doc_id, text[, category]).
    Result: (query_id, doc_id, rank, fused, score), where score is the dense
    similarity, or 0 for documents only the lexical arm found.  An empty
    lexical arm leaves the dense order.
    """
    queries = queries.filter(F.trim("text") != "")
    vectors = embedded if embedded is not None else docs.select(
        "doc_id", embedder(F.col("text")).alias("embedding"))
    d = dense.search(
        queries.select("query_id", embedder(F.col("text")).alias("embedding")), vectors, pool)
    s = sparse if sparse is not None else lexical.search(queries, docs, pool)
    limit = pool_size or max(3 * k, k)
    fused = reciprocal_rank_fusion([d, s]).withColumnRenamed("score", "fused")
    if excluded:
        fused = join_pool(fused, docs.select("doc_id", "category"), queries, 2 * pool).filter(
            ~F.coalesce(F.trim("category"), F.lit("")).isin(excluded)).drop("category")
    scored = fused.withColumn("score", F.coalesce("first_list_score", F.lit(0.0)))
    if excluded:
        place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
        scored = scored.withColumn("_place", place).drop("rank").withColumnRenamed("_place", "rank")
    scored = scored.filter(F.col("rank") <= limit)
    if min_score is not None:
        scored = scored.filter(F.col("score") >= min_score)
    return scored.select("query_id", "doc_id", "rank", "fused", "score")


def top(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.filter(F.col("rank") <= k)


def rerank(pool: DataFrame, queries: DataFrame, docs: DataFrame, reranker: Reranker,
           k: int | None = None, skip_at: float | None = None) -> DataFrame:
    """Reorder a pool by a reranker; passage text is joined only for the pool.

    With ``skip_at``, queries whose best score reaches it keep their order and
    the reranker is not called for them.  ``rank`` stays next to
    ``final_rank``; ``k`` limits the latter.
    """
    best = F.max("score").over(W.partitionBy("query_id"))
    marked = pool.withColumn(
        "_open", (best < skip_at) if skip_at is not None else F.lit(True))
    texts = join_pool(
        marked, docs.select("doc_id", F.col("text").alias("_passage")), queries, 2 * POOL,
    ).join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
    shown = F.when(F.col("_open"), F.col("_passage"))
    score = F.when(F.col("_open"), F.round(reranker(F.col("_query"), shown), 6))
    order = W.partitionBy("query_id").orderBy(
        F.col("rerank").desc_nulls_last(), F.col("rank").asc())
    ranked = texts.withColumn("rerank", score).drop(
        "_open", "_passage", "_query").withColumn(
        "final_rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("final_rank") <= k)
