"""Joining a pool of hits with the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A pool of at most this many (narrow) rows is sent to the corpus.
MAX_POOL_ROWS = 1_000_000


def join_pool(pool: DataFrame, corpus: DataFrame, queries: DataFrame, k: int,
              limit: int = MAX_POOL_ROWS) -> DataFrame:
    """Pool rows with the corpus columns of their document.

    A pool has at most k rows per query, so counting the queries bounds it.
    While the bound is small the pool travels and the corpus is only scanned;
    beyond it both sides meet in a shuffle.
    """
    most = limit // max(1, k)
    small = queries.limit(most + 1).count() <= most
    return (F.broadcast(pool) if small else pool).join(corpus, "doc_id")
