"""Queries that prepare, combine and describe corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensmere.functions import lexicons as L
from lensmere.functions import text as X
from lensmere.operators import chunking, corpus
from lensmere.plans import sql as Q
from lensmere.tables import spread, table


def html_clean(spark, sf):
    return spread(table(spark, sf, "pages")).select(
        "page_id", X.clean_markup(F.col("html")).alias("text"))


def whitespace_clean(spark, sf):
    return spread(table(spark, sf, "documents")).select(
        "doc_id", X.squeezed(F.col("text")).alias("text"),
        X.token_estimate(F.col("text"), 1).alias("token_count"))


def contextual_text(spark, sf):
    d = table(spark, sf, "documents")
    context = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("about "), F.col("lang")))
    question = F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.substring("text", 1, 20))
    return d.select("doc_id", X.contextual_text(
        context, F.col("source"), F.col("lang"), question, F.col("text")).alias("text"))


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "source", "text"))


def token_budget_chunks(spark, sf):
    return chunking.chunk_documents(_docs(spark, sf)).select(
        "doc_id", "chunk_index", "text", "token_count")


def token_budget_chunks_compact(spark, sf):
    return chunking.chunk_documents(
        _docs(spark, sf), chunking.COMPACT_BUDGET, chunking.COMPACT_OVERLAP, 1).select(
        "doc_id", "chunk_index", "text", "token_count")


def fixed_window_chunks(spark, sf):
    return chunking.window_chunks(_docs(spark, sf)).select(
        "doc_id", "chunk_index", "text", "token_count")


def chunk_ids(spark, sf):
    chunks = chunking.chunk_documents(_docs(spark, sf))
    return chunking.number_chunks(chunks, "chunk_", 6).select("id", "doc_id", "chunk_index")


def chunks_per_source(spark, sf):
    return chunking.chunk_documents(_docs(spark, sf)).groupBy("source").agg(
        F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"),
        F.sum("token_count").alias("tokens"))


def category_stats(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("source").alias("category"),
        F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("type"))
    return corpus.category_statistics(d)


def distinct_sources(spark, sf):
    return corpus.distinct_values(table(spark, sf, "documents"), "source")


def _concept_lines(spark, sf):
    """Parts as concept rows: brand as concept, name as term, type as term type."""
    p = table(spark, sf, "part")
    return corpus.concept_rows(p.select(
        F.col("p_brand").alias("rxcui"),
        F.when(F.col("p_partkey") % 7 == 0, "SPA").otherwise("eng").alias("lat"),
        F.when(F.col("p_size") % 5 == 0, "Y").otherwise("N").alias("ispref"),
        F.when(F.col("p_partkey") % 3 == 0, "RXNORM").otherwise("OTHER").alias("sab"),
        F.col("p_type").alias("tty"),
        F.when(F.col("p_partkey") % 11 == 0, " ").otherwise(
            F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("term"),
        F.col("p_partkey").alias("seq")))


def concept_rollup(spark, sf):
    return corpus.concepts(_concept_lines(spark, sf))


def concept_rollup_limited(spark, sf):
    return corpus.concepts(_concept_lines(spark, sf), max_synonyms=5, max_concepts=7)


def tty_histogram(spark, sf):
    return corpus.term_type_histogram(_concept_lines(spark, sf))


def corpus_union(spark, sf):
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"), "source", F.length("text").alias("chars"))
    p = table(spark, sf, "pages").select(
        F.concat(F.lit("page_"), "page_id").alias("id"), "url", F.length("html").alias("chars"))
    return corpus.union([d, p])


def anti_join_new(spark, sf):
    have = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    new = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return corpus.new_rows(new, have)


def append_new(spark, sf):
    have = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    new = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return corpus.append_new(have, new)


def _checkpoint(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        (F.col("event_id") % 701).alias("id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "").otherwise(
            F.concat("event_type", F.lit(" "), F.get_json_object("props", "$.k"))).alias("ctx"))


def last_write_wins(spark, sf):
    return corpus.last_rows(_checkpoint(spark, sf), "id", "seq")


def resume_todo(spark, sf):
    done = corpus.last_rows(_checkpoint(spark, sf), "id", "seq").filter("ctx <> ''")
    todo = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return corpus.new_rows(todo, done)


def _contextualised(spark, sf):
    done = corpus.last_rows(_checkpoint(spark, sf), "id", "seq")
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return corpus.attach_context(chunks, done)


def context_left_join(spark, sf):
    return _contextualised(spark, sf).select(
        "id", "context",
        X.contextual_embedding_text(F.col("context"), F.col("text")).alias("text"))


def context_coverage(spark, sf):
    return _contextualised(spark, sf).agg(
        F.count_if(F.col("context") != "").alias("used"), F.count("*").alias("chunks"))


def drug_normalize(spark, sf):
    p = table(spark, sf, "part")
    return corpus.drug_documents(p.select(
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  uses\tof "), "p_name", F.lit(" \n")))
        .alias("content"),
        F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).otherwise("").alias("text"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("source"),
        F.col("p_name").alias("name"), F.lit(None).cast("string").alias("category"),
        F.col("p_type").alias("drug_category"), F.lit("").alias("url")))


def _qa_chunks(spark, sf):
    """User turns and the replies to them as QA chunks."""
    c = table(spark, sf, "conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = user.join(reply, ["conv_id", "turn"], "left")
    odd = F.col("conv_id") % 2 == 1
    return pairs.select(
        F.concat("conv_id", F.lit("_"), "turn").alias("id"), "question", "answer",
        F.when(odd, F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: "), "answer"))
        .otherwise("").alias("text"),
        F.when(odd, F.lit("conversations")).otherwise("").alias("source"),
        F.lit("").alias("category"), F.lit("").alias("file"), F.lit("").alias("url"))


def tuning_examples(spark, sf):
    return corpus.tuning_examples(
        _qa_chunks(spark, sf), "qa", L.TUNING_SYSTEM, L.TUNING_INSTRUCTION).select(
        "id", "input", "output")


def tuning_messages(spark, sf):
    return corpus.chat_messages(corpus.tuning_examples(
        _qa_chunks(spark, sf), "qa", L.TUNING_SYSTEM, L.TUNING_INSTRUCTION))


CLEAN_CHARS = r"""[^\p{L}\p{N}_\x09-\x0d\x1c-\x20\x{85}\x{a0}.,;:!?()\-'"]"""
HTML_SQL = f"""SELECT page_id, regexp_replace(regexp_replace({Q.squeezed('html')}, '<[^>]+>', '', 'g'),
 {Q.lit(CLEAN_CHARS)}, '', 'g') AS text FROM pages"""
WS_SQL = f"""SELECT doc_id, {Q.squeezed('text')} AS text,
 greatest(1, len(text) // 4)::INT AS token_count FROM documents"""
CONTEXT_SQL = """SELECT doc_id, concat_ws(' | ', CASE WHEN doc_id % 3 = 0 THEN 'about ' || lang END,
 nullif(source, ''), nullif(lang, ''), CASE WHEN doc_id % 2 = 1 THEN substr(text, 1, 20) END)
 || ' . ' || text AS text FROM documents"""


def _chunk_ctes(budget: int, overlap: int) -> str:
    """CTE ch(doc_id, chunk_index, text) by recursion over chunk starts."""
    room = 4 * budget + 4
    return f"""dw AS (SELECT doc_id, text, {Q.words('text')} AS ws FROM documents),
 short AS (SELECT doc_id, text FROM dw WHERE len(ws) > 0 AND len(text) // 4 <= {budget}),
 lw AS (SELECT doc_id, unnest(range(1, len(ws) + 2)) AS i, unnest(list_append(ws, '')) AS w,
   len(ws) AS n FROM dw WHERE len(ws) > 0 AND len(text) // 4 > {budget}),
 lq AS (SELECT *, coalesce(sum(len(w) + 1) OVER (PARTITION BY doc_id ORDER BY i
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS q FROM lw),
 lf AS (SELECT doc_id, i, n, max(i) OVER (PARTITION BY doc_id ORDER BY q
   RANGE BETWEEN CURRENT ROW AND {room} FOLLOWING) - 1 AS fit FROM lq),
 rec AS (
   SELECT doc_id, 0 AS chunk_index, 1::BIGINT AS s, greatest(1, fit) AS e, n FROM lf WHERE i = 1
   UNION ALL
   SELECT r.doc_id, r.chunk_index + 1, f.i, greatest(r.e + 1, f.fit), r.n
   FROM rec r JOIN lf f ON f.doc_id = r.doc_id
     AND f.i = CASE WHEN r.e - r.s + 1 > {overlap} THEN r.e - {overlap} + 1 ELSE r.s END
   WHERE r.e < r.n),
 ch AS (SELECT doc_id, 0 AS chunk_index, text FROM short
   UNION ALL SELECT r.doc_id, r.chunk_index, array_to_string(ws[s:e], ' ')
   FROM rec r JOIN dw USING (doc_id))"""


CHUNK_SQL = f"""WITH RECURSIVE {_chunk_ctes(250, 50)}
SELECT doc_id, chunk_index, text, (len(text) // 4)::INT AS token_count FROM ch"""
COMPACT_SQL = f"""WITH RECURSIVE {_chunk_ctes(220, 40)}
SELECT doc_id, chunk_index, text, greatest(1, len(text) // 4)::INT AS token_count FROM ch"""
CHUNK_ID_SQL = f"""WITH RECURSIVE {_chunk_ctes(250, 50)}
SELECT 'chunk_' || lpad((row_number() OVER (ORDER BY doc_id, chunk_index) - 1)::VARCHAR, 6, '0') AS id,
 doc_id, chunk_index FROM ch"""
PER_SOURCE_SQL = f"""WITH RECURSIVE {_chunk_ctes(250, 50)}
SELECT source, count(*) AS chunks, count(DISTINCT doc_id) AS documents,
 sum(len(ch.text) // 4)::BIGINT AS tokens FROM ch JOIN documents USING (doc_id) GROUP BY source"""
WINDOW_SQL = f"""WITH w AS (SELECT doc_id, {Q.words('text')} AS ws FROM documents),
 s AS (SELECT doc_id, ws, unnest(range(0, len(ws), 600)) AS s FROM w),
 c AS (SELECT doc_id, (s // 600)::INT AS chunk_index, array_to_string(ws[s + 1:s + 600], ' ') AS text,
   len(ws[s + 1:s + 600])::INT AS token_count FROM s)
SELECT * FROM c WHERE len(text) >= 100"""
STATS_SQL = """WITH d AS (SELECT source AS category,
  CASE WHEN doc_id % 5 > 0 THEN lang ELSE 'unknown' END AS type FROM documents)
SELECT 'category' AS dimension, category AS value, count(*) AS n FROM d GROUP BY category
UNION ALL SELECT 'type', type, count(*) FROM d GROUP BY type
UNION ALL SELECT 'total', '', count(*) FROM d"""
SOURCES_SQL = "SELECT DISTINCT source FROM documents WHERE source <> ''"
LINES = """ln AS (SELECT p_brand AS rxcui, CASE WHEN p_size % 5 = 0 THEN 'Y' ELSE 'N' END AS ispref,
  CASE WHEN p_partkey % 3 = 0 THEN 'RXNORM' ELSE 'OTHER' END AS sab, p_type AS tty,
  p_name || ' ' || p_size AS term, p_partkey AS seq FROM part
  WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0)"""


def _concept_sql(cap: int, keep: str) -> str:
    return f"""WITH {LINES}, k AS (SELECT * FROM ln WHERE {keep}),
 nm AS (SELECT rxcui, coalesce(min_by(term, seq) FILTER (sab = 'RXNORM' AND ispref = 'Y'), min(term))
   AS preferred FROM k GROUP BY rxcui),
 tr AS (SELECT rxcui, term, row_number() OVER (PARTITION BY rxcui ORDER BY term) AS o
   FROM (SELECT DISTINCT rxcui, term FROM k)),
 sy AS (SELECT rxcui, string_agg(term, ', ' ORDER BY term) AS syn FROM tr WHERE o <= {cap}
   GROUP BY rxcui),
 ty AS (SELECT rxcui, string_agg(tty || ':' || n, ', ' ORDER BY tty) AS tty FROM
   (SELECT rxcui, tty, count(*) AS n FROM k GROUP BY ALL) GROUP BY rxcui),
 tx AS (SELECT rxcui, preferred, 'RxNorm concept RXCUI ' || rxcui || ': ' || preferred || '.' || chr(10)
   || 'Synonyms: ' || syn || '.' || chr(10) || 'TTY counts: ' || tty || '.' AS text
   FROM nm JOIN sy USING (rxcui) JOIN ty USING (rxcui))
SELECT 'rxnorm_' || rxcui AS id, rxcui, preferred, text,
 greatest(1, len(text) // 4)::INT AS token_count FROM tx"""


CONCEPT_SQL = _concept_sql(30, "true")
CONCEPT_LIMIT_SQL = _concept_sql(
    5, "rxcui IN (SELECT DISTINCT rxcui FROM ln ORDER BY rxcui LIMIT 7)")
TTY_SQL = f"WITH {LINES} SELECT rxcui, tty, count(*) AS n FROM ln GROUP BY ALL"
UNION_SQL = """SELECT 'doc_' || doc_id AS id, source, NULL AS url, len(text)::INT AS chars FROM documents
UNION ALL SELECT 'page_' || page_id, NULL, url, len(html)::INT FROM pages"""
ANTI_SQL = """SELECT doc_id AS id, source FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
APPEND_SQL = """SELECT doc_id AS id, quality, NULL AS source FROM labels UNION ALL
SELECT doc_id, NULL, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
CHECKPOINT = """cp AS (SELECT event_id % 701 AS id, event_id AS seq, CASE WHEN event_type = 'error'
  THEN '' ELSE event_type || ' ' || (props->>'$.k') END AS ctx FROM events),
 last AS (SELECT id, max(seq) AS seq, max_by(ctx, seq) AS ctx FROM cp GROUP BY id)"""
LAST_SQL = f"WITH {CHECKPOINT} SELECT * FROM last"
RESUME_SQL = f"""WITH {CHECKPOINT} SELECT doc_id AS id, n_chars FROM documents
WHERE doc_id NOT IN (SELECT id FROM last WHERE ctx <> '')"""
LEFT_SQL = f"""WITH {CHECKPOINT} SELECT d.doc_id AS id, coalesce(ctx, '') AS context,
 CASE WHEN coalesce(ctx, '') <> '' THEN regexp_replace(ctx || ' | ' || text, '^[ |]+|[ |]+$', '', 'g')
 ELSE text END AS text FROM documents d LEFT JOIN last ON last.id = d.doc_id"""
COVERAGE_SQL = f"""WITH {CHECKPOINT} SELECT count(*) FILTER (coalesce(ctx, '') <> '') AS used,
 count(*) AS chunks FROM documents d LEFT JOIN last ON last.id = d.doc_id"""
DRUG_SQL = f"""WITH r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN '  uses' || chr(9) || 'of ' || p_name
  || ' ' || chr(10) WHEN p_partkey % 3 > 0 THEN p_name ELSE '' END AS t, * FROM part)
SELECT {Q.squeezed('t')} AS text, CASE WHEN p_size > 25 THEN p_brand ELSE 'Drug Database' END AS source,
 'Medications' AS category, '' AS file, '' AS url, 'medication_info' AS type, p_name AS drug_name,
 p_type AS drug_category FROM r WHERE {Q.squeezed('t')} <> ''"""
QA = """qa AS (SELECT u.conv_id || '_' || u.turn AS id, u.text AS question, a.text AS answer,
  u.conv_id % 2 = 1 AS odd FROM conversations u LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
 ex AS (SELECT id, CASE WHEN odd THEN 'Question: ' || question || chr(10) || 'Context: '
   || substr('Question: ' || question || chr(10) || 'Answer: ' || answer, 1, 1500)
   ELSE 'Question: ' || question END AS input,
   to_json({'answer': answer, 'confidence': 'medium', 'citations': CASE WHEN odd THEN
   [{'source': 'conversations', 'category': '', 'file': '', 'url': ''}] ELSE [] END})::VARCHAR AS output
   FROM qa WHERE question <> '' AND answer <> '')"""
EXAMPLE_SQL = f"WITH {QA} SELECT * FROM ex"
MESSAGE_SQL = f"""WITH {QA}
SELECT id, 0 AS position, 'system' AS role, {Q.lit(L.TUNING_SYSTEM)} AS content FROM ex
UNION ALL SELECT id, 1, 'user', {Q.trimmed(Q.lit(L.TUNING_INSTRUCTION) + " || chr(10) || chr(10) || input")} FROM ex
UNION ALL SELECT id, 2, 'assistant', output FROM ex"""

REGISTRY = {
    "html_clean": (html_clean, HTML_SQL),
    "whitespace_clean": (whitespace_clean, WS_SQL),
    "contextual_text": (contextual_text, CONTEXT_SQL),
    "token_budget_chunks": (token_budget_chunks, CHUNK_SQL),
    "token_budget_chunks_compact": (token_budget_chunks_compact, COMPACT_SQL),
    "fixed_window_chunks": (fixed_window_chunks, WINDOW_SQL),
    "chunk_ids": (chunk_ids, CHUNK_ID_SQL),
    "chunks_per_source": (chunks_per_source, PER_SOURCE_SQL),
    "category_stats": (category_stats, STATS_SQL),
    "distinct_sources": (distinct_sources, SOURCES_SQL),
    "concept_rollup": (concept_rollup, CONCEPT_SQL),
    "concept_rollup_limited": (concept_rollup_limited, CONCEPT_LIMIT_SQL),
    "tty_histogram": (tty_histogram, TTY_SQL),
    "corpus_union": (corpus_union, UNION_SQL),
    "anti_join_new": (anti_join_new, ANTI_SQL),
    "append_new": (append_new, APPEND_SQL),
    "last_write_wins": (last_write_wins, LAST_SQL),
    "resume_todo": (resume_todo, RESUME_SQL),
    "context_left_join": (context_left_join, LEFT_SQL),
    "context_coverage": (context_coverage, COVERAGE_SQL),
    "drug_normalize": (drug_normalize, DRUG_SQL),
    "tuning_examples": (tuning_examples, EXAMPLE_SQL),
    "tuning_messages": (tuning_messages, MESSAGE_SQL),
}
