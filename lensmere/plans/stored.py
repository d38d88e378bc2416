"""Queries over stored indexes: built once a session and corpus, searched without reading the texts."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from lensmere.operators import dense, fusion, inverted, vectorstore
from lensmere.plans import sql as Q
from lensmere.plans.retrieval import BM25_SQL, EMBED, HYBRID_SQL, K, docs, queries
from lensmere.session import new_folder
from lensmere.tables import spread, table

MODEL = "hashing"

_folders: dict = {}


def _folder(spark: SparkSession, sf: str, kind: str) -> str:
    """Where this application keeps an index of this corpus."""
    return _folders.setdefault((spark.sparkContext.applicationId, sf, kind), new_folder(spark, kind))


def lexical_index(spark: SparkSession, sf: str) -> str:
    """The folder of the BM25 index; built, or brought up to the documents, where it is not current."""
    folder = _folder(spark, sf, "bm25")
    d = docs(spark, sf).select("doc_id", "text")
    if not inverted.is_current(d, folder):
        inverted.refresh(d, folder)
    return folder


def vector_index(spark: SparkSession, sf: str) -> str:
    folder = _folder(spark, sf, "vectors")
    vectorstore.refresh(docs(spark, sf).select(F.col("doc_id").alias("id"), "text"), folder, EMBED, MODEL)
    return folder


def bm25_stored_topk(spark, sf):
    return inverted.search(queries(spark, sf), lexical_index(spark, sf), K)


def bm25_refreshed_topk(spark, sf):
    """The index held all sources but one, and the benchmark's items; then the documents as they are now."""
    folder = new_folder(spark, "refreshed")
    d = docs(spark, sf).select("doc_id", "text", "category")
    items = table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    inverted.build(d.filter("category <> 'src0'").select("doc_id", "text").unionByName(items), folder)
    inverted.refresh(d.select("doc_id", "text"), folder)
    return inverted.search(queries(spark, sf), folder, K)


def hybrid_stored_topk(spark, sf):
    q = queries(spark, sf)
    sparse = inverted.search(q, lexical_index(spark, sf), fusion.POOL)
    stored = vectorstore.vectors(spark, vector_index(spark, sf), MODEL)
    return fusion.top(fusion.hybrid(q, docs(spark, sf), EMBED, K, embedded=stored, sparse=sparse), K)


def reembedded_topk(spark, sf):
    """Vectors of plain texts, then of those that got a context (their source): only these are embedded again."""
    folder = new_folder(spark, "contexts")
    d = spread(table(spark, sf, "documents").select("doc_id", "text", "source", "lang"))
    plain = d.select(F.col("doc_id").alias("id"), "text")
    vectorstore.refresh(plain, folder, EMBED, MODEL)
    context = F.when(F.col("lang") == "en", F.concat_ws(" ", F.lit("context"), "source"))
    vectorstore.refresh(d.select(F.col("doc_id").alias("id"), vectorstore.with_context(context, F.col("text")).alias("text")), folder, EMBED, MODEL)
    q = queries(spark, sf).select("query_id", EMBED(F.concat_ws(" ", F.lit("context src1"), "text")).alias("embedding"))
    return dense.search(q, vectorstore.vectors(spark, folder, MODEL), K)


def index_totals(spark, sf):
    """What the index knows of the corpus, without reading it."""
    now = inverted.state(spark, lexical_index(spark, sf))
    return spark.createDataFrame([(now["n_docs"], now["total_len"])], "n_docs long, total_len long")


REEMBEDDED_SQL = f"""WITH q AS (SELECT item_id AS query_id, 'context src1 ' || text AS text FROM benchmark),
 c AS (SELECT doc_id, CASE WHEN lang = 'en' THEN regexp_replace(concat_ws(' ', 'context', source) || ' | ' || text, '^[ |]+|[ |]+$', '', 'g')
   ELSE text END AS text FROM documents),
 dv AS (SELECT doc_id, vec::FLOAT[]::DOUBLE[] AS vec FROM ({Q.embedding('c', 'doc_id')})), qv AS ({Q.embedding('q', 'query_id')}),
 {Q.dense('qv', 'dv', K)} SELECT * FROM dense"""
# Stored vectors have single precision.
_DV = Q.embedding('documents', 'doc_id')
STORED_HYBRID_SQL = HYBRID_SQL.replace(f"dv AS ({_DV})", f"dv AS (SELECT doc_id, vec::FLOAT[]::DOUBLE[] AS vec FROM ({_DV}))")
TOTALS_SQL = f"SELECT count(*) AS n_docs, coalesce(sum(len({Q.tokens('text')})), 0)::BIGINT AS total_len FROM documents"

REGISTRY = {
    "bm25_stored_topk": (bm25_stored_topk, BM25_SQL),
    "bm25_refreshed_topk": (bm25_refreshed_topk, BM25_SQL),
    "hybrid_stored_topk": (hybrid_stored_topk, STORED_HYBRID_SQL),
    "reembedded_topk": (reembedded_topk, REEMBEDDED_SQL),
    "index_totals": (index_totals, TOTALS_SQL),
}
