"""Queries over the lexical and dense indexes, fusion and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lensmere.functions import text as X
from lensmere.functions import vectors as V
from lensmere.operators import dense, fusion, lexical, models
from lensmere.plans import sql as Q
from lensmere.tables import spread, table

K = 10
EMBED = models.hashing_embedder()


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select(
        "doc_id", "text", F.col("source").alias("category")))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("category"))


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


# --- term statistics ------------------------------------------------------

def tokenize_counts(spark, sf):
    return lexical.postings(lexical.tokens(docs(spark, sf)))


def term_statistics(spark, sf):
    return lexical.term_table(lexical.tokens(docs(spark, sf))).select(
        "term", "df", "cf", F.round("idf", 6).alias("idf"))


def doc_length_stats(spark, sf):
    return lexical.corpus_stats(lexical.tokens(docs(spark, sf))).select(
        "n_docs", F.round("avgdl", 6).alias("avgdl"))


def vocabulary_cap(spark, sf):
    return lexical.capped_vocabulary(
        lexical.document_frequency(lexical.tokens(docs(spark, sf))), 5000).select("term", "cf")


TOK = f"tok AS (SELECT doc_id, unnest({Q.tokens('text')}) AS term FROM documents)"
COUNTS_SQL = f"WITH {TOK} SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL"
TERMS_SQL = f"""WITH {TOK},
 df AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY ALL)
SELECT term, df, cf,
 round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5e0) / (df + 0.5e0)), 6) AS idf FROM df"""
LENGTH_SQL = f"""SELECT count(*) AS n_docs, round(avg(len({Q.tokens('text')})), 6) AS avgdl
FROM documents"""
CAP_SQL = f"""WITH {TOK} SELECT term, count(*) AS cf FROM tok GROUP BY term
ORDER BY cf DESC, term LIMIT 5000"""


# --- lexical search -------------------------------------------------------

def bm25_topk(spark, sf):
    return lexical.search(queries(spark, sf), docs(spark, sf), K)


def bm25_topk_join(spark, sf):
    return lexical.search(queries(spark, sf), docs(spark, sf), K, max_pairs=0)


def contextual_docs(spark, sf):
    d = spread(table(spark, sf, "documents"))
    return d.select("doc_id", X.contextual_text(
        F.lit(None).cast("string"), F.col("source"), F.col("lang"), F.lit(""), F.col("text"),
    ).alias("text"))


def bm25_contextual_topk(spark, sf):
    with_source = queries(spark, sf).withColumn(
        "text", F.concat_ws(" ", F.concat(F.lit("src"), F.col("query_id") % 5), "text"))
    return lexical.search(with_source, contextual_docs(spark, sf), K)


def bm25_capped_vocabulary(spark, sf):
    d = docs(spark, sf)
    kept = lexical.capped_vocabulary(lexical.document_frequency(lexical.tokens(d)), 2000)
    return lexical.search(queries(spark, sf), d, K, vocabulary=kept)


QUERIES_CTE = "q AS (SELECT item_id AS query_id, text FROM benchmark)"
BM25_SQL = f"WITH {QUERIES_CTE}, {Q.bm25('documents', 'q', K)} SELECT * FROM sparse"
CONTEXT_SQL = f"""WITH q AS (SELECT item_id AS query_id,
  concat_ws(' ', 'src' || (item_id % 5), text) AS text FROM benchmark),
 d AS (SELECT doc_id, concat(concat_ws(' | ', nullif(source, ''), nullif(lang, '')), ' . ', text)
   AS text FROM documents),
 {Q.bm25('d', 'q', K)} SELECT * FROM sparse"""
CAPPED_SQL = f"""WITH {QUERIES_CTE},
 voc AS (SELECT term FROM (SELECT unnest({Q.tokens('text')}) AS term FROM documents)
   GROUP BY term ORDER BY count(*) DESC, term LIMIT 2000),
 {Q.bm25('documents', 'q', K, vocabulary='voc')} SELECT * FROM sparse"""


# --- dense search ---------------------------------------------------------

def dense_topk(spark, sf):
    return dense.search(vector_queries(spark, sf), vectors(spark, sf), K)


def dense_topk_cells(spark, sf):
    """The same search with the query side too large to broadcast."""
    return dense.search(vector_queries(spark, sf), vectors(spark, sf), K, broadcast_bytes=1 << 16)


def dense_min_score(spark, sf):
    return dense.search(vector_queries(spark, sf), vectors(spark, sf), K, min_score=0.3)


def dense_exclude_category(spark, sf):
    hits = dense.search(vector_queries(spark, sf), vectors(spark, sf), K)
    kept = dense.exclude_categories(
        hits, vectors(spark, sf).select("doc_id", "category"), ["1", "2"],
        vector_queries(spark, sf), K)
    return kept.select("query_id", "doc_id", "score", "rank")


def search_by_category(spark, sf):
    return dense.search_category(
        vector_queries(spark, sf), vectors(spark, sf), 3, 2).select(
        "query_id", "doc_id", "score", "rank")


def stored_vector_decode(spark, sf):
    """Vectors rebuilt from their codes."""
    v = vectors(spark, sf)
    ranges = dense.dimension_ranges(v)
    decoded = dense.decode(dense.encode(v, ranges), ranges)
    return decoded.select(
        "doc_id", F.round(V.norm(F.col("embedding")), 6).alias("length"),
        F.round(F.element_at("embedding", 1), 6).alias("first"),
        F.round(F.element_at("embedding", -1), 6).alias("last"))


def sq8_codes(spark, sf):
    v = vectors(spark, sf)
    codes = dense.encode(v, dense.dimension_ranges(v))
    return codes.select("doc_id", F.posexplode("codes").alias("dim", "code")).select(
        "doc_id", "dim", F.col("code").cast("int").alias("code"))


def _approximate(spark, sf):
    v = vectors(spark, sf)
    ranges = dense.dimension_ranges(v)
    return dense.search(vector_queries(spark, sf), dense.decode(dense.encode(v, ranges), ranges), K)


def sq8_recall(spark, sf):
    exact = dense.search(vector_queries(spark, sf), vectors(spark, sf), K)
    return dense.neighbour_overlap(exact, _approximate(spark, sf), K)


def sq8_score_error(spark, sf):
    exact = dense.search(vector_queries(spark, sf), vectors(spark, sf), K)
    return dense.score_error(exact, _approximate(spark, sf)).select(
        F.round("mean_abs_error", 6).alias("mean_abs_error"))


def vector_norms(spark, sf):
    v = vectors(spark, sf)
    return v.select("doc_id", F.round(V.norm(F.col("embedding")), 6).alias("length"),
                    F.round(V.dot(F.col("embedding"), V.normalised(F.col("embedding"))), 6)
                    .alias("self_score"))


VEC = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS vec FROM embeddings),
 c AS (SELECT vec_id AS doc_id, label, embedding::DOUBLE[] AS vec FROM embeddings)"""
DENSE_SQL = f"WITH {VEC}, {Q.dense('q', 'c', K)} SELECT * FROM dense"
MIN_SQL = f"WITH {VEC}, {Q.dense('q', 'c', K, min_score=0.3)} SELECT * FROM dense"
EXCLUDE_SQL = f"""WITH {VEC}, {Q.dense('q', 'c', K)}
SELECT dense.* FROM dense JOIN c USING (doc_id) WHERE label NOT IN (1, 2)"""
CATEGORY_SQL = f"""WITH {VEC}, {Q.dense('q', 'c', 10)},
 kept AS (SELECT query_id, doc_id, score FROM dense JOIN c USING (doc_id) WHERE label = 3)
{Q.ranked('kept', 2)}"""
CODES = """e AS (SELECT vec_id AS doc_id, unnest(range(64)) AS dim,
   unnest(embedding::DOUBLE[]) AS x FROM embeddings),
 r AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM e GROUP BY dim),
 codes AS (SELECT doc_id, dim, lo, hi,
   least(255, greatest(0, CASE WHEN hi > lo THEN floor(255e0 * (x - lo) / (hi - lo)) ELSE 0 END))::INT
   AS code FROM e JOIN r USING (dim)),
 dec AS (SELECT doc_id, list(lo + (code + 0.5e0) / 255e0 * (hi - lo) ORDER BY dim) AS vec
   FROM codes GROUP BY doc_id)"""
CODES_SQL = f"WITH {CODES} SELECT doc_id, dim::INT AS dim, code FROM codes"
DECODE_SQL = f"""WITH {CODES} SELECT doc_id,
 round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS length,
 round(vec[1], 6) AS first, round(vec[-1], 6) AS last FROM dec"""
SQ8_PAIR = f"WITH {VEC}, {CODES}, {Q.dense('q', 'c', K)}, {Q.dense('q', 'dec', K, 'approx')}"
RECALL_SQL = f"""{SQ8_PAIR} SELECT d.query_id, round(count(a.doc_id) / 10e0, 6) AS overlap
FROM dense d LEFT JOIN approx a ON a.query_id = d.query_id AND a.doc_id = d.doc_id
GROUP BY d.query_id"""
ERROR_SQL = f"""{SQ8_PAIR} SELECT round(avg(abs(d.score - a.score)), 6) AS mean_abs_error
FROM dense d JOIN approx a USING (query_id, rank)"""
NORM_SQL = """WITH v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
 n AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM v)
SELECT doc_id, round(n, 6) AS length,
 round(list_dot_product(v, list_transform(v, lambda x: x / n)), 6) AS self_score FROM n"""


# --- fusion ---------------------------------------------------------------

def rrf_fuse(spark, sf):
    d, q = docs(spark, sf), queries(spark, sf)
    dense_hits = dense.search(
        q.select("query_id", EMBED(F.col("text")).alias("embedding")),
        d.select("doc_id", EMBED(F.col("text")).alias("embedding")), K)
    return fusion.reciprocal_rank_fusion([dense_hits, lexical.search(q, d, K)]).drop(
        "first_list_score")


def hybrid_topk(spark, sf):
    return fusion.top(fusion.hybrid(queries(spark, sf), docs(spark, sf), EMBED, K), K)


def hybrid_exclude_category(spark, sf):
    return fusion.top(fusion.hybrid(queries(spark, sf), docs(spark, sf), EMBED, K,
                                    excluded=["src1", "src3"]), K)


def hybrid_rerank(spark, sf):
    q, d = queries(spark, sf), docs(spark, sf)
    pool = fusion.hybrid(q, d, EMBED, K, pool_size=fusion.RERANK_POOL)
    return fusion.rerank(pool, q, d, models.overlap_reranker, K).select(
        "query_id", "doc_id", "score", "rerank", "final_rank")


def rerank_skip(spark, sf):
    q, d = queries(spark, sf), docs(spark, sf)
    pool = dense.search(
        q.select("query_id", EMBED(F.col("text")).alias("embedding")),
        d.select("doc_id", EMBED(F.col("text")).alias("embedding")), fusion.RERANK_POOL)
    return fusion.rerank(pool, q, d, models.overlap_reranker, K, fusion.RERANK_SKIP).select(
        "query_id", "doc_id", "score", "rerank", "final_rank")


EMB = f"""dv AS ({Q.embedding('documents', 'doc_id')}),
 qv AS ({Q.embedding('q', 'query_id')})"""
RRF_SQL = f"""WITH {QUERIES_CTE}, {EMB}, {Q.dense('qv', 'dv', K)},
 {Q.bm25('documents', 'q', K)}, {Q.rrf(['dense', 'sparse'])} SELECT * FROM fused"""
HYBRID = f"""WITH {QUERIES_CTE}, {EMB}, {Q.dense('qv', 'dv', 50)},
 {Q.bm25('documents', 'q', 50)}, {Q.rrf(['dense', 'sparse'])}"""


def _hybrid_sql(k: int, keep: str = "true") -> str:
    return f"""{HYBRID}, kept AS (SELECT f.query_id, f.doc_id, row_number() OVER
   (PARTITION BY f.query_id ORDER BY f.rank) AS rank, f.score AS fused
   FROM fused f JOIN documents d USING (doc_id) WHERE {keep}),
 pool AS (SELECT k.query_id, k.doc_id, k.rank, k.fused, coalesce(d.score, 0) AS score
   FROM kept k LEFT JOIN dense d ON d.query_id = k.query_id AND d.doc_id = k.doc_id
   WHERE k.rank <= {k})"""


HYBRID_SQL = f"{_hybrid_sql(K)} SELECT * FROM pool"
HYBRID_EXCLUDE_SQL = f"{_hybrid_sql(K, 'source NOT IN (' + chr(39) + 'src1' + chr(39) + ', ' + chr(39) + 'src3' + chr(39) + ')')} SELECT * FROM pool"
OVERLAP = f"""CASE WHEN len(list_distinct({Q.tokens('q.text')})) = 0 THEN 0 ELSE
 round(len(list_intersect(list_distinct({Q.tokens('q.text')}), {Q.tokens('d.text')}))
 / len(list_distinct({Q.tokens('q.text')})), 6) END"""
RERANK_TAIL = f""", rr AS (SELECT p.query_id, p.doc_id, p.score, p.rank, {OVERLAP} AS rerank
  FROM pool p JOIN documents d USING (doc_id) JOIN q USING (query_id))
SELECT query_id, doc_id, score, rerank, row_number() OVER (PARTITION BY query_id
 ORDER BY rerank DESC NULLS LAST, rank) AS final_rank FROM rr QUALIFY final_rank <= {K}"""
RERANK_SQL = _hybrid_sql(50) + RERANK_TAIL
SKIP_SQL = f"""WITH {QUERIES_CTE}, {EMB}, {Q.dense('qv', 'dv', 50, 'pool')},
 m AS (SELECT *, max(score) OVER (PARTITION BY query_id) >= 0.86 AS skip FROM pool),
 rr AS (SELECT p.query_id, p.doc_id, p.score, p.rank,
   CASE WHEN skip THEN NULL ELSE {OVERLAP} END AS rerank
   FROM m p JOIN documents d USING (doc_id) JOIN q USING (query_id))
SELECT query_id, doc_id, score, rerank, row_number() OVER (PARTITION BY query_id
 ORDER BY rerank DESC NULLS LAST, rank) AS final_rank FROM rr QUALIFY final_rank <= {K}"""


REGISTRY = {
    "tokenize_counts": (tokenize_counts, COUNTS_SQL),
    "term_statistics": (term_statistics, TERMS_SQL),
    "doc_length_stats": (doc_length_stats, LENGTH_SQL),
    "vocabulary_cap": (vocabulary_cap, CAP_SQL),
    "bm25_topk": (bm25_topk, BM25_SQL),
    "bm25_topk_join": (bm25_topk_join, BM25_SQL),
    "bm25_contextual_topk": (bm25_contextual_topk, CONTEXT_SQL),
    "bm25_capped_vocabulary": (bm25_capped_vocabulary, CAPPED_SQL),
    "dense_topk": (dense_topk, DENSE_SQL),
    "dense_topk_cells": (dense_topk_cells, DENSE_SQL),
    "dense_min_score": (dense_min_score, MIN_SQL),
    "dense_exclude_category": (dense_exclude_category, EXCLUDE_SQL),
    "search_by_category": (search_by_category, CATEGORY_SQL),
    "sq8_codes": (sq8_codes, CODES_SQL),
    "stored_vector_decode": (stored_vector_decode, DECODE_SQL),
    "sq8_recall": (sq8_recall, RECALL_SQL),
    "sq8_score_error": (sq8_score_error, ERROR_SQL),
    "vector_norms": (vector_norms, NORM_SQL),
    "rrf_fuse": (rrf_fuse, RRF_SQL),
    "hybrid_topk": (hybrid_topk, HYBRID_SQL),
    "hybrid_exclude_category": (hybrid_exclude_category, HYBRID_EXCLUDE_SQL),
    "hybrid_rerank": (hybrid_rerank, RERANK_SQL),
    "rerank_skip": (rerank_skip, SKIP_SQL),
}
