"""Exact top-k by inner product with bounds from segment statistics.

A vector is cut into segments, each kept as its mean and its deviation.  The distance of two vectors is
at least that of their segment means and deviations, so with the norms known the inner product is at
most the sum over segments of ``length * (mean * mean' + deviation * deviation')``.  Bounds are taken
coarse to fine; what may still reach the k-th best score found so far is computed exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SEGMENTS = (4, 16)
#: Queries that one pass over the candidates answers; they are broadcast, so this bounds their size.
QUERY_BLOCK = 4_096
CANDIDATE_ROWS = 2_048
SALTS = 32


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Two columns per segment, root of the length times mean and deviation: their products sum to the bound."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = x[:, a:b]
        out += [math.sqrt(b - a) * part.mean(1), math.sqrt(b - a) * part.std(1)]
    return np.stack(out, 1) if out else np.zeros((len(x), 0))


def _matrix(column, width: int | None = None) -> np.ndarray:
    """An Arrow column of long lists as a matrix; a shorter vector is continued by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    lengths = np.diff(at)
    width = max(int(lengths.max(initial=0)), 1) if width is None else width
    if len(lengths) and (lengths == width).all():
        return flat[at[0]:at[-1]].reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    for i, n in enumerate(lengths):
        out[i, :min(n, width)] = flat[at[i]:at[i] + min(n, width)]
    return out


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of x with q; beyond 64 bits they stop at the largest long."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0))
    if most * len(q) < 2 ** 52:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    limit = 2 ** 63 - 1
    return np.array([max(-limit - 1, min(limit, sum(int(a) * int(b) for a, b in zip(row, q)))) for row in x], np.int64)


class Best:
    """The k best (score, id) of every query so far: higher score first, then the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = [np.zeros(0, np.int64)] * n
        self.id = [np.zeros(0, np.int64)] * n
        self.floor = np.full(n, -np.inf)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.append(self.score[q], score), np.append(self.id[q], ids)
        top = np.lexsort((ids, ~score))[:self.k] if len(score) > self.k else slice(None)
        self.score[q], self.id[q] = score[top], ids[top]
        if len(self.score[q]) == self.k:
            self.floor[q] = float(self.score[q].min())


def _scan(block, k: int):
    def run(batches):
        ids_q, q_int = block.value
        q = q_int.astype(np.float64)
        width = q.shape[1]
        by_level = [features(q, s) for s in SEGMENTS]
        norms = np.linalg.norm(q, axis=1)
        best = Best(len(q), k)
        for batch in batches:
            all_ids, all_x = batch.column("vec_id").to_numpy(zero_copy_only=False), _matrix(batch.column("v"), width)
            for at in range(0, len(all_ids), CANDIDATE_ROWS):
                ids, x_int = all_ids[at:at + CANDIDATE_ROWS], all_x[at:at + CANDIDATE_ROWS]
                x = x_int.astype(np.float64)
                levels = [features(x, s) for s in SEGMENTS]
                # Bounds are sums of doubles: the slack covers their rounding.
                slack = 1e-9 * (norms * np.linalg.norm(x, axis=1).max(initial=0)) + 1e-6
                coarse = levels[0] @ by_level[0].T
                for j in range(len(q)):
                    left = np.flatnonzero(coarse[:, j] >= best.floor[j] - slack[j])
                    left = left[ids[left] != ids_q[j]]
                    if best.floor[j] == -np.inf and len(left) > k:  # the likeliest first, for a floor
                        top = left[np.argpartition(-coarse[left, j], k - 1)[:k]]
                        best.add(j, exact(x_int[top], q_int[j]), ids[top])
                        rest = np.ones(len(ids), bool)
                        rest[top] = False
                        left = left[rest[left] & (coarse[left, j] >= best.floor[j] - slack[j])]
                    for fine, own in zip(levels[1:], by_level[1:]):
                        if len(left):
                            left = left[fine[left] @ own[j] >= best.floor[j] - slack[j]]
                    if len(left):
                        best.add(j, exact(x_int[left], q_int[j]), ids[left])
        n = [len(s) for s in best.score]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(q)), n), pa.int32()), pa.array(np.repeat(ids_q, n), pa.int64()),
             pa.array(np.concatenate(best.id) if n else [], pa.int64()), pa.array(np.concatenate(best.score) if n else [], pa.int64())],
            names=["query", "query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): every component x as floor(scale * x); rows that cannot take part are left out.

    Left out are null keys and vectors that are null or hold a null or non-finite component.
    """
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(good, F.lit(False)))
            .select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v")))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k candidates of the highest inner product.

    Both inputs are (vec_id long, v array<long>).  Ties go to the smaller id; a candidate with the query's
    own id is passed over; fewer candidates give fewer rows.  Repeated candidate rows count each.  Equal
    query rows are asked once; an id with different vectors is asked for each of them, and the ranks of
    each come back under the id.  Of vectors of unequal length the shorter one is continued by zeros.
    An empty side gives an empty result.

    Queries go out in blocks of a fixed size, each answered by one pass over the candidates; a task keeps
    k rows per query, and these are merged in two steps.
    """
    spark = candidates.sparkSession
    queries = queries.distinct()
    blocks = math.ceil(queries.count() / block)
    out = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).orderBy("vec_id", "v").toArrow()
        if not rows.num_rows:
            continue
        sent = spark.sparkContext.broadcast((rows.column("vec_id").to_numpy(), _matrix(rows.column("v"))))
        found = candidates.mapInArrow(_scan(sent, k), "query int, query_id long, vec_id long, score long").select(
            F.lit(b).alias("block"), "*", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = [F.col("score").desc(), "vec_id"]
    first = Window.partitionBy("block", "query", "salt").orderBy(*order)
    last = Window.partitionBy("block", "query").orderBy(*order)
    return (out.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
            .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
