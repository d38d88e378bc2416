"""Exact inner-product search over a table of vectors, and 8-bit codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from lensmere.functions import vectors as V
from lensmere.operators.pools import join_pool
from lensmere.operators.topk import BestPerQuery
from lensmere.session import SENT_AFTER, free_memory
from lensmere.tables import even_keys

# Query vectors up to this many bytes travel to every task; more meet the corpus in cells.
BROADCAST_BYTES = 8 << 20
# Corpus rows and queries of a cell, fewer where vectors are so long that either would take more bytes.
CELL_ROWS, BLOCK_QUERIES, CELL_BYTES = 98_304, 32_768, 48 << 20
# Cells that are worth a task each at least, in all and per core, and the bytes in a shuffle of a row that is found.
LEAST_CELLS, CELLS_A_CORE, FOUND_BYTES = 12, 2, 15
SCORE_DIGITS = 6
# Terms beyond this leave rounding errors that SCORE_DIGITS do not hide.
LARGE_TERM = 1e6
# Size of the score matrix a task holds at a time.
BLOCK_ENTRIES = 4_000_000
# Parts in which the tasks' best rows of a query are merged before the last step.
MERGE_PARTS = 16
# Tasks at a time up to which one step merges them: at most so many times k rows for a query.
MERGE_TASKS = 256


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Rounded products; those with large terms add them in one order, whatever the matrices' shapes and the processor."""
    scores = queries @ vectors.T
    with np.errstate(over="ignore", invalid="ignore"):
        most = [np.abs(x).max(1, initial=0.0) for x in (queries, vectors)]
        if most[0].max(initial=0.0) * most[1].max(initial=0.0) >= LARGE_TERM:
            rows, columns = np.divmod(np.flatnonzero(np.multiply.outer(*most) >= LARGE_TERM), max(1, len(vectors)))
            for a in range(0, len(rows), BLOCK_ENTRIES // 16):
                r, c = rows[a:a + BLOCK_ENTRIES // 16], columns[a:a + BLOCK_ENTRIES // 16]
                scores[r, c] = np.einsum("ij,ij->i", queries[r], vectors[c])
    return np.round(scores, SCORE_DIGITS)


def _scan(best: BestPerQuery, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
          min_score: float | None) -> None:
    step = max(1, BLOCK_ENTRIES // max(1, len(ids)))
    for start in range(0, len(queries), step):
        scores = _scores(queries[start:start + step], vectors)
        keep = None if min_score is None else scores >= min_score
        best.add_matrix(start, ids, scores, keep)


# Sizes of the matrices of a cell: queries and rows at a time, and the rows that give the first floor.
CELL_QUERIES, CELL_COLUMNS, FIRST_COLUMNS = 512, 8_192, 1_024


def _best_of_cell(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, min_score: float | None):
    """(query number, id, score) of the best k rows per query; ids ascend.

    Scores are computed in single precision first.  What could, by the bound of their error, reach a query's
    k-th score so far is computed in double precision, so the result is that of :func:`_scan`.
    """
    single_q, single_v = queries.astype(np.float32), vectors.astype(np.float32)
    norms = np.sqrt((queries * queries).sum(1)), np.sqrt((vectors * vectors).sum(1))
    most = float(norms[0].max(initial=0.0) * norms[1].max(initial=0.0))
    coarse = np.isfinite(most) and most < 1e30 and bool(np.isfinite(single_q).all() and np.isfinite(single_v).all())
    out = []
    for start in range(0, len(queries), CELL_QUERIES):
        q, sq, nq = (x[start:start + CELL_QUERIES] for x in (queries, single_q, norms[0]))
        best = BestPerQuery(k)
        at = 0
        while at < len(ids):
            # The rounding of scores may lift a row by half a unit above what its product is.
            end = at + (FIRST_COLUMNS if at == 0 else CELL_COLUMNS)
            if at == 0 or not coarse:
                _scan(best, q, ids[:end][at:], vectors[at:end], min_score)
            else:
                floor = np.full(len(q), -np.inf if min_score is None else float(min_score))
                count = np.bincount(best.query, minlength=len(q))
                full = np.flatnonzero(count >= k)
                last = np.cumsum(count)[full] - 1
                floor[full] = np.maximum(floor[full], best.scores[last])
                # Error of a product of n single-precision terms, of both sides' conversion, and of underflow.
                error = (2 * q.shape[1] + 8) * 2.0 ** -24 * nq * float(norms[1][at:end].max(initial=0.0)) + 1e-30
                bar = floor - error - 10.0 ** -SCORE_DIGITS
                # Rounded down to single precision.
                bar = np.nextafter(bar.astype(np.float32), np.float32(-np.inf))
                wide = sq @ single_v[at:end].T >= bar[:, None]
                rows, columns = np.divmod(np.flatnonzero(wide), wide.shape[1])
                better = []
                step = max(1, BLOCK_ENTRIES // 8 // max(1, q.shape[1]))  # both sides' vectors are copied
                for a in range(0, len(rows), step):
                    r, c = rows[a:a + step], columns[a:a + step] + at
                    scores = np.round(np.einsum("ij,ij->i", q[r], vectors[c]), SCORE_DIGITS)
                    keep = scores >= floor[r]
                    better.append((r[keep], ids[c[keep]], scores[keep]))
                if sum(len(x[0]) for x in better):
                    best.add(*(np.concatenate(x) for x in zip(*better)))
            at = end
        if best.ids is not None:
            out.append((best.query + start, best.ids, best.scores))
    if not out:
        return np.empty(0, np.int64), ids[:0], np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _ids(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else \
        column.to_numpy()


def rank(df: DataFrame, k: int, by: str = "query_id", score: str = "score",
         item: str = "doc_id") -> DataFrame:
    """Rank within each query by score, ties by id, and keep the first k."""
    order = W.partitionBy(by).orderBy(F.col(score).desc(), F.col(item).asc())
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def merge(df: DataFrame, k: int) -> DataFrame:
    """:func:`rank` of what many tasks found for each query.

    A task sends k rows per query at most, as row-number filters are applied
    before the shuffle.  Where more than ``MERGE_TASKS`` tasks may send, a few
    parts keep their best first, so no task merges the rows of all others for
    one query.  The rows are the same either way.
    """
    if df.sparkSession.sparkContext.defaultParallelism <= MERGE_TASKS:
        return rank(df, k)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS))
    order = W.partitionBy("query_id", "_part").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    best = df.withColumn("_part", part).withColumn("_n", F.row_number().over(order)).filter(
        F.col("_n") <= k)
    return rank(best.drop("_part", "_n"), k)


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.filter(
        F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))


def _complete(rows):
    """:func:`_usable` of Arrow rows; as a filter of the DataFrame it would have a model make every vector twice."""
    column = rows.column("embedding")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    holes = column.flatten().is_null()
    if not column.null_count and not pa.compute.any(holes).as_py():
        return rows
    keep = column.is_valid().to_numpy(zero_copy_only=False).copy()
    keep[pa.compute.list_parent_indices(column).filter(holes).to_numpy()] = False
    return rows.filter(pa.array(keep))


def search(queries: DataFrame, corpus: DataFrame, k: int, min_score: float | None = None,
           broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Best k corpus rows per query by inner product.

    ``queries``: (query_id, embedding); ``corpus``: (doc_id, embedding).
    Result: (query_id, doc_id, score, rank); scores are rounded before ranking.

    Each task scans its share of the corpus once against all queries and keeps
    whatever the corpus size.  Queries of more than ``broadcast_bytes`` stay
    where they are: both sides are cut into blocks of bounded size, and each
    pair of blocks is a cell that one task searches.  Rows without a vector,
    or with a null in it, take no part.
    """
    queries = queries.select("query_id", V.as_double(F.col("embedding")).alias("embedding"))
    corpus = corpus.select("doc_id", V.as_double(F.col("embedding")).alias("embedding"))
    out = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("doc_id", corpus.schema["doc_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    sample, _ = bounded_table(_usable(queries), broadcast_bytes)
    if sample is None:
        free_memory()
        found = _search_cells(queries, corpus, k, min_score, out)
    else:
        found = _search_broadcast(sample, corpus, k, min_score, out)
    return merge(found, k)


def bounded_table(df: DataFrame, max_bytes: int, first: int = 2_000) -> tuple:
    """(rows, limit) of a vector table, with rows None when it exceeds ``max_bytes``.

    Never more than the limit (plus one row) reaches the driver.
    """
    few = df.limit(first + 1).toArrow()
    dim = max(1, len(few["embedding"][0])) if few.num_rows else 1
    most = max(1, max_bytes // (8 * dim))
    if few.num_rows > first and most > first:
        few = df.limit(most + 1).toArrow()
    return (None if few.num_rows > most else few), most


def _search_broadcast(queries: pa.Table, corpus: DataFrame, k: int, min_score: float | None,
                      out: T.StructType) -> DataFrame:
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast(
        (queries["query_id"].combine_chunks(), _matrix(queries["embedding"]))
    )

    def scan(batches):
        query_ids, matrix = shared.value
        best = BestPerQuery(k)
        schema = None
        for whole in batches:
            batch = _complete(whole)
            if batch.num_rows == 0 or len(query_ids) == 0:
                continue
            schema = batch.schema.field("doc_id").type
            _scan(best, matrix, _ids(batch.column("doc_id")),
                  _matrix(batch.column("embedding")), min_score)
        if schema is not None and best.ids is not None:
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(pa.array(best.query)), pa.array(best.ids, schema),
                 pa.array(best.scores)],
                ["query_id", "doc_id", "score"],
            )

    return corpus.mapInArrow(scan, out)


def _search_cells(queries: DataFrame, corpus: DataFrame, k: int, min_score: float | None,
                  out: T.StructType) -> DataFrame:
    """Blocks of queries against shares of the corpus, each pair in one task; the driver sees counts only.

    Every vector goes to as many cells as the other side has blocks.
    """
    spark = corpus.sparkSession
    asked = queries.filter("embedding IS NOT NULL").first()
    wide = 8 * max(1, len(asked["embedding"]) if asked else 1)
    # Rows are counted without their vectors, which a model may have to make; those without one count as well.
    n_queries, n_rows = (x.select(c).count() for x, c in ((queries, "query_id"), (corpus, "doc_id")))
    most = max(1, CELL_BYTES // wide)
    blocks = max(1, -(-n_queries // min(BLOCK_QUERIES, CELL_ROWS, most)))
    shares = max(1, -(-n_rows // min(CELL_ROWS, most)))
    # Few large cells would leave cores idle.  The corpus goes out once per block, queries and their best once per
    # share; the cheaper grows.
    while blocks * shares < max(LEAST_CELLS, CELLS_A_CORE * spark.sparkContext.defaultParallelism):
        if blocks * n_rows * wide < shares * n_queries * (wide + k * FOUND_BYTES):
            blocks += 1
        else:
            shares += 1

    cells = even_keys(spark, blocks * shares)
    keys = F.array(*[F.lit(x) for x in cells])

    def dealt(df: DataFrame, item: str, own: int, other: int, cell) -> DataFrame:
        # By id and vector, so that neither repeated ids nor repeated vectors meet in one block.
        block = F.pmod(F.xxhash64(item, "embedding"), F.lit(own)).cast("int")
        return df.withColumn("_b", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).select(
            F.get(keys, cell).alias("cell"), item, "embedding").repartition(len(cells), "cell").groupBy("cell")

    asked = dealt(queries, "query_id", blocks, shares, F.col("_b") * shares + F.col("_o"))
    rows = dealt(corpus, "doc_id", shares, blocks, F.col("_o") * shares + F.col("_b"))
    kinds = {f.name: f.dataType.simpleString() for f in out}

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        found = _best_of_tables(_complete(q), _complete(c), k, min_score)
        free_memory(SENT_AFTER)
        return found

    return asked.cogroup(rows).applyInArrow(
        run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double").repartition("query_id")


def _best_of_tables(q: pa.Table, c: pa.Table, k: int, min_score: float | None) -> pa.Table:
    ids, query_ids = c.column("doc_id").combine_chunks(), q.column("query_id").combine_chunks()
    if not len(ids) or not len(query_ids):
        return pa.table({"query_id": query_ids.slice(0, 0), "doc_id": ids.slice(0, 0), "score": pa.array([], pa.float64())})
    # Rows by id, so that a place stands for its id, whatever its type; a null comes last.
    order = pa.compute.sort_indices(ids)
    vectors = _matrix(c.column("embedding"))[order.to_numpy()]
    query, place, scores = _best_of_cell(_matrix(q.column("embedding")), np.arange(len(ids)), vectors, k, min_score)
    return pa.table({"query_id": query_ids.take(pa.array(query)), "doc_id": ids.take(order.take(pa.array(place))), "score": pa.array(scores)})


def exclude_categories(hits: DataFrame, attributes: DataFrame, excluded: list,
                       queries: DataFrame, k: int) -> DataFrame:
    """Drop hits of unwanted categories after the top-k, so fewer rows may remain."""
    return join_pool(hits, attributes, queries, k).filter(
        ~F.coalesce(F.trim(F.col("category").cast("string")), F.lit("")).isin(excluded)
    )


def search_category(queries: DataFrame, corpus: DataFrame, category, k: int,
                    min_score: float | None = None) -> DataFrame:
    """A pool of 5k hits restricted to a category, then the best k of those."""
    pool = search(queries, corpus, max(5 * k, k), min_score)
    named = join_pool(pool, corpus.select("doc_id", "category"), queries, 5 * k)
    kept = named.filter(
        F.trim(F.col("category").cast("string")) == F.lit(str(category).strip())
    )
    return rank(kept.drop("rank"), k)


def result_projection(chunks: DataFrame) -> DataFrame:
    """The columns a search result shows; question and answer only for QA pairs."""
    qa = F.col("type") == "QA_pair"
    return chunks.select(
        F.col("id").alias("chunk_id"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c)
          for c in ("text", "source", "category", "url", "type")],
        "token_count", "rxcui",
        F.when(qa, F.col("question")).alias("question"),
        F.when(qa, F.col("answer")).alias("answer"),
    )


# --- 8-bit codes ----------------------------------------------------------

def dimension_ranges(corpus: DataFrame) -> DataFrame:
    """(dim, lo, hi) over all vectors; partial aggregation leaves dim rows per task."""
    return (
        corpus.select(F.posexplode(V.as_double(F.col("embedding"))).alias("dim", "x"))
        .groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    )


def _bounds(ranges: DataFrame, which: str) -> Column:
    """The per-dimension bounds as one array, attached as a scalar subquery."""
    ordered = F.sort_array(F.collect_list(F.struct("dim", which)))
    return ranges.agg(F.transform(ordered, lambda s: s[which]).alias(which)).scalar()


def encode(corpus: DataFrame, ranges: DataFrame) -> DataFrame:
    """Vectors as 0..255 codes per dimension."""
    with_bounds = corpus.select(
        "doc_id", V.as_double(F.col("embedding")).alias("v"),
        _bounds(ranges, "lo").alias("lo"), _bounds(ranges, "hi").alias("hi"),
    )

    def code(x: Column, i: Column) -> Column:
        lo, hi = F.get("lo", i), F.get("hi", i)
        scaled = F.when(hi > lo, F.floor(F.lit(255.0) * (x - lo) / (hi - lo))).otherwise(0)
        return F.least(F.lit(255), F.greatest(F.lit(0), scaled)).cast("smallint")

    return with_bounds.select("doc_id", F.transform("v", code).alias("codes"))


def decode(codes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Codes back to vectors, at the middle of each step."""
    with_bounds = codes.select(
        "doc_id", "codes",
        _bounds(ranges, "lo").alias("lo"), _bounds(ranges, "hi").alias("hi"),
    )
    return with_bounds.select(
        "doc_id",
        F.transform(
            "codes",
            lambda c, i: F.get("lo", i)
            + (c + F.lit(0.5)) / F.lit(255.0) * (F.get("hi", i) - F.get("lo", i)),
        ).alias("embedding"),
    )


def neighbour_overlap(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """Share of each query's exact neighbours that the approximate search also found."""
    both = exact.select("query_id", "doc_id").join(
        approximate.select("query_id", "doc_id", F.lit(1).alias("hit")),
        ["query_id", "doc_id"], "left",
    )
    return both.groupBy("query_id").agg(
        F.round(F.count("hit") / F.lit(float(k)), 6).alias("overlap")
    )


def score_error(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Mean absolute difference of the scores at equal rank."""
    pairs = exact.select("query_id", "rank", "score").join(
        approximate.select("query_id", "rank", F.col("score").alias("other")),
        ["query_id", "rank"],
    )
    return pairs.agg(F.avg(F.abs(F.col("score") - F.col("other"))).alias("mean_abs_error"))
