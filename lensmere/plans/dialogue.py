"""Queries over conversations and expert routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensmere.functions import lexicons as L
from lensmere.functions import text as X
from lensmere.operators import conversation, fusion, models, routing
from lensmere.plans import sql as Q
from lensmere.plans import utterances as U
from lensmere.plans.retrieval import docs
from lensmere.tables import table

EMBED = models.hashing_embedder()


def _log(spark, sf):
    return table(spark, sf, "conversations")


def context_projection(spark, sf):
    return conversation.context_messages(_log(spark, sf))


def memory_window(spark, sf):
    return conversation.recent(_log(spark, sf)).select("conv_id", "turn", "role", "back")


def memory_text(spark, sf):
    log = U.utterances(spark, sf)
    last = log.filter(F.col("role") == "user").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("text"))
    return conversation.memory(log, current=last)


def memory_text_long(spark, sf):
    """The launcher's larger limits, where the tail is cut at a line."""
    return conversation.memory(_log(spark, sf), turns=10, chars=1200)


def followup_fold(spark, sf):
    return conversation.fold_follow_ups(U.utterances(spark, sf))


def last_assistant(spark, sf):
    return conversation.previous_text(U.utterances(spark, sf), "assistant", "reply").select(
        "conv_id", "turn", F.coalesce("reply", F.lit("")).alias("reply"))


def conversation_list(spark, sf):
    return conversation.listing(U.utterances(spark, sf))


def _store_events(spark, sf):
    u = U.utterances(spark, sf)
    action = (
        F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 3), "rename")
        .when((F.col("conv_id") % 11 == 0) & (F.col("turn") > 4), "delete")
        .otherwise("append")
    )
    return u.select("conv_id", F.col("turn").alias("seq"), action.alias("action"),
                    F.col("text").alias("payload"))


def conversation_state(spark, sf):
    return conversation.current_state(_store_events(spark, sf))


def _routed(spark, sf):
    u = U.utterances(spark, sf).filter("role = 'user'")
    modality = F.when(F.col("conv_id") % 9 == 0, "skin").when(
        F.col("conv_id") % 9 == 1, "chest_xray")
    return routing.gate(u.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text",
        modality.alias("modality")), EMBED)


def expert_route(spark, sf):
    return _routed(spark, sf).select("query_id", "position", "expert", "weight")


def expert_lenses(spark, sf):
    return routing.lens_queries(_routed(spark, sf))


def expert_directive(spark, sf):
    return routing.directive(_routed(spark, sf))


def expert_load(spark, sf):
    """How often each expert is consulted and its mean share."""
    return _routed(spark, sf).groupBy("expert").agg(
        F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"))


def _bench_routed(spark, sf):
    b = table(spark, sf, "benchmark")
    phrase = F.element_at(F.array(*[F.lit(p) for p in U.PHRASES]),
                          (F.col("item_id") % U.N + 1).cast("int"))
    return routing.gate(b.select(
        F.col("item_id").alias("query_id"), F.concat_ws(" ", phrase, "text").alias("text"),
        F.lit(None).cast("string").alias("modality")), EMBED)


def expert_evidence_pool(spark, sf):
    return routing.gather(_bench_routed(spark, sf), docs(spark, sf), EMBED)


def expert_evidence_fused(spark, sf):
    return routing.gather(_bench_routed(spark, sf), docs(spark, sf), EMBED, order="fused")


def softmax_gate(spark, sf):
    """Shares of event types per user by their mean value."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.round(F.avg("value"), 6).alias("score"))
    return routing.softmax(e, "user_id", "score", 10.0).select(
        "user_id", "event_type", F.round("weight", 6).alias("weight"))


CONTEXT_SQL = "SELECT conv_id, turn, role, text AS content FROM conversations"
WINDOW_SQL = """SELECT conv_id, turn, role, row_number() OVER
 (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 4"""


def _memory_sql(source: str, turns: int, chars: int, skip: bool) -> str:
    per = max(80, min(220, chars // turns))
    drop = f"""AND NOT (role = 'user' AND {Q.trimmed('text')} = (SELECT {Q.trimmed('max_by(text, turn)')}
      FROM u x WHERE x.role = 'user' AND x.conv_id = r.conv_id))""" if skip else ""
    return f"""r AS (SELECT * FROM {source} QUALIFY row_number() OVER
   (PARTITION BY conv_id ORDER BY turn DESC) <= {turns}),
 s AS (SELECT conv_id, turn, role, {Q.squeezed('text')} AS said FROM r WHERE true {drop}),
 l AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN {Q.lit(L.USER_LABEL)}
     ELSE {Q.lit(L.ASSISTANT_LABEL)} END || ': ' || CASE WHEN len(said) > {per}
     THEN regexp_replace(substr(said, 1, {per}), {Q.lit(X.WS + '+$')}, '') || '...' ELSE said END,
     chr(10) ORDER BY turn) AS t FROM s WHERE said <> '' GROUP BY conv_id)
SELECT conv_id, CASE WHEN len(t) <= {chars} THEN t
 WHEN contains(right(t, {chars}), chr(10)) THEN substr(right(t, {chars}),
   instr(right(t, {chars}), chr(10)) + 1) ELSE right(t, {chars}) END AS memory FROM l"""


MEMORY_SQL = f"WITH {U.SQL}, {_memory_sql('u', 4, 800, True)}"
MEMORY_LONG_SQL = f"WITH {_memory_sql('conversations', 10, 1200, False)}"
PREV = """last_value(CASE WHEN role = '{role}' THEN text END IGNORE NULLS) OVER
 (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
FOLD_SQL = f"""WITH {U.SQL}, p AS (SELECT *, {PREV.format(role='user')} AS earlier FROM u)
SELECT conv_id, turn, CASE WHEN {Q.word_count('text')} < 8 AND earlier IS NOT NULL
 THEN {Q.trimmed("substr(earlier, 1, 300) || chr(10) || text")} ELSE text END AS query
FROM p WHERE role = 'user'"""
REPLY_SQL = f"""WITH {U.SQL} SELECT conv_id, turn,
 coalesce({PREV.format(role='assistant')}, '') AS reply FROM u"""
LIST_SQL = f"""WITH {U.SQL} SELECT conv_id, coalesce(substr(min_by({Q.trimmed('text')},
  CASE WHEN role = 'user' AND {Q.trimmed('text')} <> '' THEN turn END), 1, 60), 'New chat') AS title,
 max(turn) AS last_turn, count(*) AS message_count FROM u GROUP BY conv_id"""
STATE_SQL = f"""WITH {U.SQL}, e AS (SELECT conv_id, turn AS seq, text AS payload,
  CASE WHEN conv_id % 7 = 0 AND turn = 3 THEN 'rename' WHEN conv_id % 11 = 0 AND turn > 4
  THEN 'delete' ELSE 'append' END AS action FROM u),
 s AS (SELECT conv_id, coalesce(
   max_by(substr(coalesce(nullif(payload, ''), 'Untitled'), 1, 80), seq) FILTER (action = 'rename'),
   substr(min_by({Q.trimmed('payload')}, seq) FILTER (action = 'append'), 1, 60), 'New chat') AS title,
  count(*) FILTER (action = 'append') AS message_count, max(seq) AS updated,
  coalesce(max(seq) FILTER (action = 'delete'), -1) AS deleted FROM e GROUP BY conv_id)
SELECT conv_id, title, message_count, updated FROM s WHERE deleted < updated"""

EXPERT_ROWS = [(i, e[0], e[1], e[2], e[4]) for i, e in enumerate(L.EXPERTS)]
KEYWORD_ROWS = [(i, k) for i, e in enumerate(L.EXPERTS) for k in e[3]]


def _route_ctes(queries: str) -> str:
    """CTEs from {queries}(query_id, text, modality) to routed."""
    return f"""{queries},
 ex AS (SELECT * FROM {Q.rows(EXPERT_ROWS)} x(i, expert, lens, text, m)),
 kw AS (SELECT * FROM {Q.rows(KEYWORD_ROWS)} x(i, keyword)),
 rq AS (SELECT query_id, text, modality, CASE WHEN {Q.trimmed('text')} = '' THEN
   'general health question' ELSE {Q.trimmed('text')} END AS q FROM rawq),
 qv AS ({Q.embedding('rq', 'query_id', 'q')}), pv AS ({Q.embedding('ex', 'i')}),
 kh AS (SELECT DISTINCT query_id, i FROM rq, kw WHERE contains(lower(q), keyword)),
 sc AS (SELECT rq.query_id, ex.i, ex.expert, ex.lens, ex.m, rq.modality, rq.text,
   round(list_dot_product(qv.vec, pv.vec), 6)
   + CASE WHEN kh.i IS NOT NULL THEN 0.18e0 ELSE 0 END
   + CASE WHEN ex.m = rq.modality THEN 0.45e0 ELSE 0 END AS s
   FROM rq JOIN qv USING (query_id) CROSS JOIN ex JOIN pv USING (i)
   LEFT JOIN kh ON kh.query_id = rq.query_id AND kh.i = ex.i),
 ez AS (SELECT *, exp((s - max(s) OVER (PARTITION BY query_id)) / 0.35e0) AS z FROM sc),
 wt AS (SELECT *, round(z / sum(z) OVER (PARTITION BY query_id), 9) AS w FROM ez),
 od AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, i) AS o FROM wt),
 ch AS (SELECT *, o <= 2 AND w >= 0.12e0 AS strong FROM od),
 cd AS (SELECT *, CASE WHEN bool_or(strong) OVER (PARTITION BY query_id) THEN strong
   ELSE i = {len(L.EXPERTS) - 1} END AS chosen FROM ch),
 gd AS (SELECT *, bool_or(m = modality AND NOT chosen) OVER (PARTITION BY query_id) AS forced,
   row_number() OVER (PARTITION BY query_id, chosen ORDER BY o) AS co FROM cd),
 fin AS (SELECT *, CASE WHEN forced AND m = modality THEN 0 WHEN forced THEN co ELSE co - 1 END AS position
   FROM gd WHERE (chosen AND (NOT coalesce(forced, false) OR co <= 1))
     OR (coalesce(forced, false) AND m = modality)),
 routed AS (SELECT query_id, text AS query, position::INT AS position, expert, lens,
   round(w / sum(w) OVER (PARTITION BY query_id), 3) AS weight FROM fin)"""


UQ = f"""{U.SQL}, rawq AS (SELECT conv_id * 1000 + turn AS query_id, text,
   CASE conv_id % 9 WHEN 0 THEN 'skin' WHEN 1 THEN 'chest_xray' END AS modality
   FROM u WHERE role = 'user')"""
ROUTE_SQL = f"WITH {_route_ctes(UQ)} SELECT query_id, position, expert, weight FROM routed"
LENS_SQL = f"""WITH {_route_ctes(UQ)} SELECT query_id, position, expert,
 replace(lens, '{{q}}', query) AS text FROM routed"""
DIRECTIVE_SQL = f"""WITH {_route_ctes(UQ)} SELECT query_id, {Q.lit(L.DIRECTIVE_HEAD)} ||
 string_agg(expert || ' (' || round_even(weight * 100, 0)::INT || '%)', ', ' ORDER BY position)
 || {Q.lit(L.DIRECTIVE_TAIL)} AS directive FROM routed GROUP BY query_id"""
LOAD_SQL = f"""WITH {_route_ctes(UQ)} SELECT expert, count(*) AS n,
 round(avg(weight), 6) AS mean_weight FROM routed GROUP BY expert"""
BQ = f"""rawq AS (SELECT item_id AS query_id, NULL AS modality, concat_ws(' ',
   ({Q.array(U.PHRASES)})[item_id % {U.N} + 1], text) AS text FROM benchmark)"""


def _pool_sql(order: str) -> str:
    return f"""WITH {_route_ctes(BQ)},
 lq AS (SELECT query_id || '#' || position AS query_id, replace(lens, '{{q}}', query) AS text FROM routed),
 lk AS (SELECT query_id || '#' || position AS lens_id, query_id, position, expert FROM routed),
 dv AS ({Q.embedding('documents', 'doc_id')}), lv AS ({Q.embedding('lq', 'query_id')}),
 {Q.dense('lv', 'dv', 50)}, {Q.bm25('documents', 'lq', 50)}, {Q.rrf(['dense', 'sparse'])},
 h AS (SELECT f.query_id AS lens_id, f.doc_id, f.rank, f.score AS fused,
   coalesce(d.score, 0) AS score FROM fused f LEFT JOIN dense d
   ON d.query_id = f.query_id AND d.doc_id = f.doc_id WHERE f.rank <= 4),
 un AS (SELECT lk.query_id, doc_id, expert, position, rank, fused, score FROM h JOIN lk USING (lens_id)
   QUALIFY row_number() OVER (PARTITION BY lk.query_id, doc_id ORDER BY position, rank) = 1)
SELECT query_id, doc_id, expert, position, rank, score, row_number() OVER
 (PARTITION BY query_id ORDER BY {order} DESC, position, rank) AS place FROM un QUALIFY place <= 12"""


POOL_SQL, POOL_FUSED_SQL = _pool_sql("score"), _pool_sql("fused")
SOFTMAX_SQL = """WITH e AS (SELECT user_id, event_type, round(avg(value), 6) AS s FROM events GROUP BY ALL),
 z AS (SELECT *, exp((s - max(s) OVER (PARTITION BY user_id)) / 10e0) AS z FROM e)
SELECT user_id, event_type, round(z / sum(z) OVER (PARTITION BY user_id), 6) AS weight FROM z"""

REGISTRY = {
    "context_projection": (context_projection, CONTEXT_SQL),
    "memory_window": (memory_window, WINDOW_SQL),
    "memory_text": (memory_text, MEMORY_SQL),
    "memory_text_long": (memory_text_long, MEMORY_LONG_SQL),
    "followup_fold": (followup_fold, FOLD_SQL),
    "last_assistant": (last_assistant, REPLY_SQL),
    "conversation_list": (conversation_list, LIST_SQL),
    "conversation_state": (conversation_state, STATE_SQL),
    "expert_route": (expert_route, ROUTE_SQL),
    "expert_lenses": (expert_lenses, LENS_SQL),
    "expert_directive": (expert_directive, DIRECTIVE_SQL),
    "expert_load": (expert_load, LOAD_SQL),
    "expert_evidence_pool": (expert_evidence_pool, POOL_SQL),
    "expert_evidence_fused": (expert_evidence_fused, POOL_FUSED_SQL),
    "softmax_gate": (softmax_gate, SOFTMAX_SQL),
}
