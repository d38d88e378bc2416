"""Model seams: embedding, reranking, generation and summarising.

Each seam is a function from columns to a column (or from DataFrame to
DataFrame), so a real model can take its place.  The defaults are
deterministic stand-ins that need no weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lensmere.functions import text as X
from lensmere.session import free_memory

EMBEDDING_DIM = 64

# An embedder maps a text column to an ARRAY<DOUBLE> column of unit length.
Embedder = Callable[[Column], Column]


def bucket_and_sign(token: str, dim: int) -> tuple[int, int]:
    digest = hashlib.md5(token.encode("utf-8")).hexdigest()
    sign = 1 if int(digest[8:9], 16) % 2 == 0 else -1
    return int(digest[:8], 16) % dim, sign


def hashing_embedder(dim: int = EMBEDDING_DIM, stopwords: list | None = None) -> Embedder:
    """Signed feature hashing of the index tokens, scaled to unit length."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(tokens: pa.Array) -> pa.Array:
        n = len(tokens)
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        places = [bucket_and_sign(t, dim) for t in coded.dictionary.to_pylist()]
        buckets = np.array([p[0] for p in places], dtype=np.int64)
        signs = np.array([p[1] for p in places], dtype=np.float64)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
        if len(codes):
            sums = np.bincount(
                rows * dim + buckets[codes], weights=signs[codes], minlength=n * dim
            ).reshape(n, dim)
        else:
            sums = np.zeros((n, dim))
        lengths2 = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        lengths2[lengths2 == 0] = 1.0
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
        del coded, codes, rows
        free_memory()
        return pa.ListArray.from_arrays(offsets, pa.array((sums / lengths2).ravel()))

    return lambda text: embed(X.index_tokens(X.or_empty(text), stopwords))


def embed_distinct(df: DataFrame, embedder: Embedder) -> DataFrame:
    """Rows with ``embedding``; equal texts are encoded once (for costly models)."""
    once = df.select("text").distinct().withColumn("embedding", embedder(F.col("text")))
    return df.join(once, df["text"].eqNullSafe(once["text"])).drop(once["text"])


def embed_constants(texts: list, dim: int = EMBEDDING_DIM) -> np.ndarray:
    """The default embedder for a handful of fixed texts (prototypes, anchors)."""
    import regex

    stop = set(X.L.INDEX_STOPWORDS)
    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        for token in regex.findall(X.INDEX_TOKEN, text.lower()):
            if token not in stop:
                bucket, sign = bucket_and_sign(token, dim)
                out[i, bucket] += sign
    lengths = np.sqrt((out * out).sum(axis=1, keepdims=True))
    lengths[lengths == 0] = 1.0
    return out / lengths


# A reranker maps (query text, passage text) to a score column.
Reranker = Callable[[Column, Column], Column]


def overlap_reranker(query: Column, passage: Column) -> Column:
    """Share of the query's distinct tokens that occur in the passage."""
    wanted = F.array_distinct(X.index_tokens(X.or_empty(query)))
    shared = F.array_intersect(wanted, X.index_tokens(X.or_empty(passage)))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.size(shared) / F.size(wanted))


def no_hypotheticals(query: Column) -> Column:
    """Default generator of hypothetical passages: none, the query stands alone."""
    return F.lit("")


def extractive_summary(texts: Column, title_words: int | None = None, shown: int | None = None) -> Column:
    """Default cluster summary: labelled lines made of the representative texts.

    Nothing is cut unless asked: ``title_words`` of the first text, ``shown`` texts.
    """
    title = X.squeezed(F.coalesce(F.element_at(texts, 1), F.lit("")))
    if title_words is not None:
        title = F.array_join(F.slice(F.split(title, " "), 1, title_words), " ")
    body = F.array_join(texts if shown is None else F.slice(texts, 1, shown), " ")
    return F.concat(F.lit("TITLE: "), title, F.lit("\nOVERVIEW: "), body)
