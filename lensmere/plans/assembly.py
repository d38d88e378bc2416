"""Queries on evidence, explanations, safety and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensmere.functions import lexicons as L
from lensmere.functions import text as X
from lensmere.operators import (conversation, evidence, explain, graph, lexical, replies, safety,
                                symptoms)
from lensmere.operators.pools import join_pool
from lensmere.operators.running import running_count
from lensmere.plans import sql as Q
from lensmere.plans import utterances as U
from lensmere.plans.retrieval import QUERIES_CTE, docs, queries
from lensmere.tables import spread, table

POOL = 12


def passages(spark, sf):
    """The BM25 pool of every benchmark query with its texts."""
    hits = lexical.search(queries(spark, sf), docs(spark, sf), POOL)
    d = spread(table(spark, sf, "documents").select(
        "doc_id", "text", "source", F.col("lang").alias("category")))
    return join_pool(hits, d, queries(spark, sf), POOL)


PASSAGES = f"""{QUERIES_CTE}, {Q.bm25('documents', 'q', POOL)},
 p AS (SELECT s.query_id, s.rank, s.score, doc_id, d.text, d.source, d.lang AS category
   FROM sparse s JOIN documents d USING (doc_id))"""


# --- evidence -------------------------------------------------------------

def budget_fill(spark, sf):
    return evidence.fill_budget(passages(spark, sf))


def _subtopics(spark, sf):
    """A subtopic per distinct word of the query: the word or its beginning."""
    words = F.array_distinct(X.index_tokens(F.col("text")))
    return queries(spark, sf).select("query_id", F.transform(
        words, lambda w: F.array(w, F.substring(w, 1, 5))).alias("subtopics"))


def subtopic_coverage(spark, sf):
    filled = evidence.fill_budget(passages(spark, sf))
    return filled.join(_subtopics(spark, sf), "query_id").select(
        "query_id", evidence.covered(F.col("evidence"), F.col("subtopics")).alias("covered"),
        F.size("subtopics").alias("subtopics"))


def coverage_summary(spark, sf):
    c = subtopic_coverage(spark, sf)
    return c.agg(F.round(F.avg(F.col("covered") / F.col("subtopics")), 3).alias("mean_fraction"),
                 F.round(F.avg("covered"), 2).alias("mean_covered"), F.count("*").alias("n"))


def overview_union(spark, sf):
    """Overview items (the first passages under their source's name) in front of the leaf passages."""
    p = passages(spark, sf)
    overview = p.filter("rank <= 4").withColumn("text", F.concat_ws(": ", "source", "text"))
    return evidence.union_by_prefix(overview, p)


def evidence_block(spark, sf):
    p = passages(spark, sf)
    directive = queries(spark, sf).filter("query_id % 2 = 0").select(
        "query_id", F.concat(F.lit(" Panel for "), "query_id").alias("directive"))
    return evidence.evidence_block(p, directive)


def reference_list(spark, sf):
    return evidence.reference_list(passages(spark, sf))


def literature_block(spark, sf):
    return evidence.literature(passages(spark, sf).filter("rank <= 5"))


def citation_list(spark, sf):
    return evidence.citations(passages(spark, sf))


def query_sources(spark, sf):
    return evidence.query_sources(passages(spark, sf))


def _prompts(spark, sf):
    block = evidence.evidence_block(passages(spark, sf))
    return queries(spark, sf).join(block, "query_id", "left").select(
        "query_id", X.template(evidence.PROMPT_TEMPLATE, {
            "EVIDENCE_BLOCK": F.col("evidence"), "USER_QUESTION": F.col("text"),
            "SYMPTOM_LINE": evidence.symptom_line(
                symptoms.merge_entities(symptoms.rule_entities(F.col("text")))),
            "CONVERSATION_MEMORY": F.lit(None).cast("string")}).alias("prompt"))


def prompt_compose(spark, sf):
    return _prompts(spark, sf)


def prompt_truncate(spark, sf):
    lit = evidence.literature(passages(spark, sf))
    whole = queries(spark, sf).join(lit, "query_id").select("query_id", F.concat(
        F.lit("MEDICAL LITERATURE CONTEXT:\n"), "literature", F.lit("\nQuestion: "), "text")
        .alias("prompt"))
    return whole.select("query_id", evidence.truncate_prompt(F.col("prompt"), 400).alias("prompt"))


def medication_draft_references(spark, sf):
    return safety.draft_references(passages(spark, sf))


BUDGET = """fb AS (SELECT *, coalesce(sum(len(text)) OVER (PARTITION BY query_id ORDER BY rank
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM p WHERE text <> ''),
 f AS (SELECT query_id, string_agg(substr(text, 1, 2000 - b), ' ' ORDER BY rank) AS evidence
   FROM fb WHERE b < 2000 GROUP BY query_id)"""
BUDGET_SQL = f"WITH {PASSAGES}, {BUDGET} SELECT * FROM f"
SUBTOPICS = f"""sw AS (SELECT query_id, list_distinct_ordered AS ws FROM (SELECT query_id,
   (SELECT list(t ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT unnest({Q.tokens('q.text')}) AS t,
   generate_subscripts({Q.tokens('q.text')}, 1) AS i) GROUP BY t)) AS list_distinct_ordered FROM q)),
 st3 AS (SELECT query_id, list_transform(ws, lambda w: [w, substr(w, 1, 5)]) AS subs FROM sw),
 cv AS (SELECT f.query_id, len(list_filter(subs, lambda syn: len(list_filter(syn,
   lambda s: contains(lower(evidence), s))) > 0))::INT AS covered, len(subs)::INT AS subtopics
   FROM f JOIN st3 USING (query_id))"""
COVER_SQL = f"WITH {PASSAGES}, {BUDGET}, {SUBTOPICS} SELECT * FROM cv"
COVER_SUM_SQL = f"""WITH {PASSAGES}, {BUDGET}, {SUBTOPICS}
SELECT round(avg(covered / subtopics), 3) AS mean_fraction, round(avg(covered), 2) AS mean_covered,
 count(*) AS n FROM cv"""
OVERVIEW_SQL = f"""WITH {PASSAGES}, b AS (SELECT query_id, rank, concat_ws(': ', source, text) AS text, 0 AS tier
   FROM p WHERE rank <= 4 UNION ALL SELECT query_id, rank, text, 1 FROM p),
 k AS (SELECT * FROM b WHERE substr(text, 1, 60) <> '' QUALIFY row_number() OVER (PARTITION BY query_id,
   substr(text, 1, 60) ORDER BY tier, rank) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS rank, tier, text FROM k"""
RFIND = "(CASE WHEN contains(h, '{m}') THEN len(h) - instr(reverse(h), reverse('{m}')) - 1 ELSE -1 END)"
CUT = "greatest(" + ", ".join(RFIND.format(m=m) for m in (". ", "? ", "! ")) + ")"
BLOCK = f"""h AS (SELECT query_id, rank, text, {Q.trimmed('substr(text, 1, 400)')} AS h FROM p WHERE rank <= 10),
 sn AS (SELECT query_id, rank, CASE WHEN len(text) > 400 AND {CUT} >= 133 THEN substr(h, 1, {CUT} + 1)
   ELSE h END AS s FROM h),
 sd AS (SELECT * FROM sn WHERE s <> '' QUALIFY row_number() OVER
   (PARTITION BY query_id, lower(s) ORDER BY rank) = 1),
 bl AS (SELECT query_id, string_agg('- ' || s, chr(10) ORDER BY rank) AS evidence FROM sd GROUP BY query_id)"""
BLOCK_SQL = f"""WITH {PASSAGES}, {BLOCK} SELECT query_id, CASE WHEN query_id % 2 = 0 THEN
 'Panel for ' || query_id || chr(10) || evidence ELSE evidence END AS evidence FROM bl"""
REFS_SQL = f"""WITH {PASSAGES}, d AS (SELECT * FROM p WHERE rank <= 10 QUALIFY row_number() OVER
 (PARTITION BY query_id, source, category ORDER BY rank) = 1)
SELECT query_id, string_agg('• ' || source || ' — ' || category, chr(10) ORDER BY rank) AS sources
FROM d GROUP BY query_id"""
LIT = """li AS (SELECT query_id, string_agg(chr(10) || 'Ref[' || (rank - 1) || ']: ' || source || ' ('
 || category || '): ' || substr(text, 1, 400) || '...' || chr(10), chr(10) ORDER BY rank) AS literature
 FROM p {where} GROUP BY query_id)"""
LIT_SQL = f"WITH {PASSAGES}, {LIT.format(where='WHERE rank <= 5')} SELECT * FROM li"
CITE_SQL = f"""WITH {PASSAGES} SELECT query_id, rank, 'Reference [' || (rank - 1) || ']: ' || source
 AS citation FROM p WHERE rank <= 5"""
QSRC_SQL = f"""WITH {PASSAGES} SELECT query_id, array_to_string(list_sort(list(DISTINCT source)), ',')
 AS sources FROM p GROUP BY query_id"""
TRUNCATE_SQL = f"""WITH RECURSIVE {PASSAGES}, {LIT.format(where='')},
 pr AS (SELECT query_id, 'MEDICAL LITERATURE CONTEXT:' || chr(10) || literature || chr(10)
   || 'Question: ' || text AS prompt FROM q JOIN li USING (query_id)),
 ls AS (SELECT query_id, prompt, string_split(prompt, chr(10)) AS ls FROM pr),
 r AS (SELECT query_id, 0 AS i, []::VARCHAR[] AS kept, 0::BIGINT AS chars, 0 AS refs FROM ls
   UNION ALL SELECT query_id, i + 1, CASE WHEN take THEN list_append(kept, line) ELSE kept END,
     CASE WHEN take THEN chars + len(line) + 1 ELSE chars END,
     CASE WHEN isref THEN refs + 1 ELSE refs END FROM (
     SELECT r.query_id, r.i, kept, chars, refs, ls[i + 1] AS line,
       contains(ls[i + 1], 'MEDICAL LITERATURE CONTEXT:') OR contains(ls[i + 1], 'Question:') AS iskey,
       NOT iskey AND contains(ls[i + 1], 'Ref[') AND refs < 3 AS isref,
       iskey OR isref OR greatest(chars - 1, 0) // 4 < 400 * 0.8e0 AS take
     FROM r JOIN ls ON ls.query_id = r.query_id WHERE i < len(ls.ls))),
 fin AS (SELECT query_id, array_to_string(kept, chr(10)) AS t FROM r
   QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1)
SELECT query_id, CASE WHEN len(prompt) // 4 <= 400 THEN prompt ELSE
 CASE WHEN len(t) // 4 > 400 THEN substr(t, 1, 1600) ELSE t END || {Q.lit(evidence.PROMPT_NOTE)} END AS prompt
FROM ls JOIN fin USING (query_id)"""
DRAFT_REF_SQL = f"""WITH {PASSAGES} SELECT query_id, string_agg('[Ref ' || (rank - 1) || '] '
 || substr(text, 1, 400), chr(10) || chr(10) ORDER BY rank) AS "references" FROM p WHERE rank <= 3 GROUP BY query_id"""


# --- explanations ---------------------------------------------------------

def document_keywords(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("query_id"), "text")
    return explain.keywords(d).select("query_id", "keyword", "n", "place")


def evidence_alignment(spark, sf):
    return explain.alignment(queries(spark, sf), passages(spark, sf))


def explanation_confidence(spark, sf):
    level = F.when(F.col("query_id") % 3 == 0, "CRITICAL").otherwise("LOW")
    return explain.confidence(queries(spark, sf), passages(spark, sf), level)


def explanation_package(spark, sf):
    level = F.when(F.col("query_id") % 3 == 0, "CRITICAL").otherwise("LOW")
    q = queries(spark, sf)
    p = passages(spark, sf)
    packed = explain.package(q, p, level, graph.of_queries(q, p, DRUGS))
    return packed.select(
        "query_id", "confidence", F.coalesce(F.size("evidence"), F.lit(0)).alias("evidence_count"),
        F.element_at("evidence", 1)["support"].alias("best_support"),
        F.element_at("counterfactuals", -1).alias("last_counterfactual"),
        F.element_at("outline", 1).alias("first_sentence"),
        F.size("nodes").alias("nodes"), F.size("edges").alias("edges"))


REPLY_HEADS = [
    "Answer: Drink water!! Rest.",
    '"medical_assessment": "It is likely a tension headache. Consider rest because stress matters."',
    '{"answer": "Take it slowly.", "candidate_drugs": ["ibuprofen"], "sources": []}',
    'Sure {"response": "not quite json',
    "SPECIFIC: dosing of paracetamol is limited to four grams a day\nBROAD: analgesics and their safe use",
    "TITLE: Managing chronic pain at home\nOVERVIEW: Pain lasting beyond three months.\n It has many causes.",
    "<think>hmm</think> A short context\nabout fever.",
    "Assessment follows.\nMild fever, possible viral illness.\nRecommendations below\nRest well.\nDrink.\n"
    "Patient should know this.\nKeep warm.\nWarning: seek immediate help.\nclosing line",
    "**Bold** and *soft* text with ```code``` block.\n\n\n\nNext line follows.",
    "Opening words.\nClinical impression: consider bacterial sinusitis, and likely migraine headache.",
    "With fever and chest pain and shortness of breath, we suggest a follow-up. It is a red flag.",
    '"quoted whole reply that is long enough to matter for everyone"',
    "Important to know: sleep matters.\nMore on sleep.\nTherapy options exist.\nWalk daily.",
    "specific: tiny",
]
REPLY_TAILS = ["Feel free to ask more.", "Let me know if anything is unclear.", "Stay well!"]


def reply_texts(spark, sf):
    """Assistant turns with typical openings and closings, by conversation and turn."""
    c = table(spark, sf, "conversations").filter("role = 'assistant'")
    head = F.element_at(F.array(*[F.lit(h) for h in REPLY_HEADS]), (
        (F.col("conv_id") * 5 + F.col("turn")) % len(REPLY_HEADS) + 1).cast("int"))
    tail = F.element_at(F.array(*[F.lit(t) for t in REPLY_TAILS]), (
        F.col("conv_id") % len(REPLY_TAILS) + 1).cast("int"))
    mode = (F.col("conv_id") + F.col("turn")) % 3
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"),
        F.when(mode == 0, F.concat(head, F.lit("\n"), "text"))
        .when(mode == 1, F.concat("text", F.lit("\n"), head))
        .otherwise(F.concat("text", F.lit(" "), tail)).alias("text"))


REPLIES = f"""rp AS (SELECT conv_id * 1000 + turn AS reply_id, CASE (conv_id + turn) % 3
  WHEN 0 THEN ({Q.array(REPLY_HEADS)})[(conv_id * 5 + turn) % {len(REPLY_HEADS)} + 1] || chr(10) || text
  WHEN 1 THEN text || chr(10) || ({Q.array(REPLY_HEADS)})[(conv_id * 5 + turn) % {len(REPLY_HEADS)} + 1]
  ELSE text || ' ' || ({Q.array(REPLY_TAILS)})[conv_id % {len(REPLY_TAILS)} + 1] END AS text
  FROM conversations WHERE role = 'assistant')"""


def reasoning_outline(spark, sf):
    return reply_texts(spark, sf).select("reply_id", F.posexplode(
        explain.outline(F.col("text"))).alias("position", "sentence"))


def _reply_symptoms(spark, sf):
    entities = symptoms.merge_entities(symptoms.rule_entities(X.squeezed(F.col("text"))))
    return reply_texts(spark, sf).withColumn("symptoms", F.transform(entities, lambda e: e["text"]))


def counterfactuals(spark, sf):
    return _reply_symptoms(spark, sf).select("reply_id", F.posexplode(
        explain.counterfactuals(F.col("text"), F.col("symptoms"))).alias("position", "statement"))


# The passages' category is their language here; these stand for the medication category.
DRUGS = ("en",)


def _graph(spark, sf):
    return graph.of_queries(queries(spark, sf), passages(spark, sf), DRUGS)


def graph_nodes(spark, sf):
    return _graph(spark, sf).select("query_id", F.explode("nodes").alias("n")).select(
        "query_id", "n.id", "n.label", "n.type")


def graph_edges(spark, sf):
    return _graph(spark, sf).select("query_id", F.explode("edges").alias("e")).select(
        "query_id", "e.source", "e.target", "e.label")


def _corpus(spark, sf):
    return spread(table(spark, sf, "documents").select("text", F.col("lang").alias("category")))


def corpus_graph_nodes(spark, sf):
    return graph.nodes(_corpus(spark, sf), DRUGS)


def corpus_graph_edges(spark, sf):
    return graph.edges(_corpus(spark, sf), DRUGS)


def passage_conditions(spark, sf):
    """Condition candidates of each query's first passages."""
    p = passages(spark, sf).filter("rank <= 3")
    texts = p.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("ts"))
    return texts.select("query_id", F.posexplode(explain.condition_candidates(
        F.lit(""), F.col("ts"))).alias("position", "condition"))


XTOK = f"""list_filter(regexp_extract_all(lower({Q.squeezed('text')}), {Q.lit(X.EXPLANATION_TOKEN)}),
 lambda t: t NOT IN ({', '.join(Q.lit(s) for s in L.EXPLANATION_STOPWORDS)}) AND NOT regexp_full_match(t, '[0-9]+'))"""


def _keys(source: str, top: int, name: str) -> str:
    return f"""{name} AS (SELECT query_id, keyword, n, row_number() OVER (PARTITION BY query_id
   ORDER BY n DESC, keyword) AS place FROM (SELECT query_id, keyword, count(*) AS n FROM
   (SELECT query_id, unnest({XTOK}) AS keyword FROM {source}) GROUP BY ALL) QUALIFY place <= {top})"""


KEYWORD_SQL = f"""WITH d AS (SELECT doc_id AS query_id, text FROM documents), {_keys('d', 20, 'k')}
SELECT * FROM k"""
KA = """ka AS (SELECT query_id, list(keyword ORDER BY place) AS keys FROM k GROUP BY query_id)"""
PM = f"""pm AS (SELECT p.query_id, p.rank, p.source, keys, list_filter(keys, lambda x:
   contains(lower({Q.squeezed('p.text')}), x)) AS m FROM p JOIN ka USING (query_id))"""
ALIGN_SQL = f"""WITH {PASSAGES}, {_keys('q', 25, 'k')}, {KA}, {PM},
 s AS (SELECT *, round(len(m) / len(keys), 3) AS support FROM pm)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, rank) AS place,
 rank - 1 AS passage_index, source, array_to_string(m[1:15], ',') AS matched, support FROM s QUALIFY place <= 5"""
CONF_SQL = f"""WITH {PASSAGES}, {_keys('q', 20, 'k')}, {KA}, {PM},
 sn AS (SELECT query_id, len(list_distinct(flatten(list(m)))) AS seen FROM pm GROUP BY query_id)
SELECT q.query_id, CASE WHEN keys IS NULL THEN 0.5 ELSE round(greatest(0.3e0, least(0.92e0,
 0.45e0 + 0.45e0 * (coalesce(seen, 0) / len(keys)) - CASE WHEN q.query_id % 3 = 0 THEN 0.1e0 ELSE 0 END)), 3)
 END::DOUBLE AS confidence FROM q LEFT JOIN ka USING (query_id) LEFT JOIN sn USING (query_id)"""
MARK_Q = " + ".join(f"contains(lower(s), {Q.lit(m)})::INT" for m in L.REASONING_MARKERS)
MARK = " + ".join(f"contains(lower(s), {Q.lit(m)})::INT" for m in L.REASONING_MARKERS)
OUTLINE_SQL = f"""WITH {REPLIES}, sp AS (SELECT reply_id, string_split(regexp_replace({Q.trimmed('text')},
   '([.!?])[ \\t\\n\\x0b\\x0c\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM rp),
 sx AS (SELECT reply_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM sp),
 w AS (SELECT *, {MARK} AS w FROM sx),
 st AS (SELECT *, row_number() OVER (PARTITION BY reply_id ORDER BY w DESC, i) AS o FROM w
   WHERE w > 0 AND len(s) > 12),
 pk AS (SELECT reply_id, s, o FROM st WHERE o <= 6 UNION ALL
   SELECT reply_id, s, i FROM sx WHERE i <= 4 AND reply_id NOT IN (SELECT reply_id FROM st))
SELECT reply_id, (row_number() OVER (PARTITION BY reply_id ORDER BY o) - 1)::INT AS position,
 {Q.trimmed('s')} AS sentence FROM pk WHERE {Q.trimmed('s')} <> ''"""
SYM_TERMS = [(i, t) for i, (_, t) in enumerate(L.flatten(L.SYMPTOM_KEYWORDS))]


def _symptom_ctes(source: str, key: str) -> str:
    """CTE rs({key}, text, symptoms): merged symptom texts in order of position."""
    return f"""kw AS (SELECT * FROM {Q.rows(SYM_TERMS)} k(no, term)),
 cl AS (SELECT {key}, text, {Q.squeezed('text')} AS ct FROM {source}),
 es AS (SELECT {key}, list([{{'no': no, 'text': term, 'start': instr(lower(ct), term)}}] ORDER BY no) AS es
   FROM cl JOIN kw ON contains(lower(ct), term) GROUP BY {key}),
 mg AS (SELECT {key}, unnest(list_reduce(es, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y:
   abs(y.start - x[1].start) < 5 AND contains(x[1].text, y.text))) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM es),
 sy AS (SELECT {key}, list(k.text ORDER BY k.start, k.no) AS symptoms FROM mg GROUP BY {key}),
 rs AS (SELECT s.{key}, s.text, coalesce(symptoms, []) AS symptoms FROM {source} s LEFT JOIN sy USING ({key}))"""


RSYM = _symptom_ctes("rp", "reply_id")
# Words with letters beyond ASCII become a digit: still a word, but never a name.
PLAIN = ("regexp_replace({t}, '[A-Za-z0-9_]*[\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{24F}\\x{370}-\\x{1FFF}]"
         "[\\p{L}\\p{N}_]*', '0', 'g')")


def _plain(text: str) -> str:
    return PLAIN.replace("{t}", text)


COMPOSE_SQL = f"""WITH {PASSAGES}, {BLOCK}, {_symptom_ctes('q', 'query_id')} SELECT query_id,
 'CONVERSATION MEMORY:' || chr(10) || chr(10) || chr(10) || 'BACKGROUND EVIDENCE:' || chr(10)
 || coalesce(evidence, '') || chr(10) || chr(10) || CASE WHEN len(symptoms) > 0 THEN 'Symptoms noted: '
 || array_to_string(symptoms[1:5], ', ') ELSE '' END || chr(10) || chr(10)
 || 'User question:' || chr(10) || rs.text AS prompt
FROM rs LEFT JOIN bl USING (query_id)"""


def _among(word: str, phrase: str) -> str:
    return (f"(len(list_filter(symptoms, lambda s: contains(s, {Q.lit(word)}))) > 0 "
            f"OR contains(lower(text), {Q.lit(phrase)}))")


COUNTER_SQL = f"""WITH {REPLIES}, {RSYM}, c AS (SELECT reply_id, list_filter([
  CASE WHEN {_among('fever', 'fever')} THEN {Q.lit(L.COUNTERFACTUAL_FEVER)} END,
  CASE WHEN {_among('chest', 'chest pain')} THEN {Q.lit(L.COUNTERFACTUAL_CHEST)} END,
  CASE WHEN {_among('breath', 'shortness of breath')} THEN {Q.lit(L.COUNTERFACTUAL_BREATH)} END,
  {Q.lit(L.COUNTERFACTUAL_GENERIC)}], lambda s: s IS NOT NULL) AS c FROM rs)
SELECT reply_id, (generate_subscripts(c, 1) - 1)::INT AS position, unnest(c) AS statement FROM c"""
TITLE = """array_to_string(list_transform(string_split(x, ' '),
 lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"""
PHRASE = Q.lit(chr(92) + 'b' + L.CONDITION_PHRASE_PATTERN + chr(92) + 'b')
NAME = Q.lit(chr(92) + 'b' + L.TREATMENT_NAME_PATTERN + chr(92) + 'b')
GRAPH = f"""{_symptom_ctes('q', 'query_id')},
 cc AS (SELECT query_id, regexp_replace({Q.trimmed('x')}, '[.,;:)]+$', '') AS x FROM (SELECT query_id,
   unnest(regexp_extract_all(text, {Q.lit(L.CONDITION_CUE_PATTERN)}, 1)) AS x FROM rs)),
 ca AS (SELECT query_id, {TITLE} AS x FROM cc WHERE x <> '' AND len(x) <= 40 UNION ALL
   SELECT query_id, x FROM (SELECT query_id, {Q.trimmed('x')} AS x FROM (SELECT query_id,
     unnest(regexp_extract_all({_plain('text')}, {PHRASE}, 1)) AS x FROM p WHERE rank <= 3)) WHERE len(x) BETWEEN 3 AND 32),
 cd AS (SELECT query_id, list_sort(list(DISTINCT x))[1:8] AS c FROM ca GROUP BY query_id),
 tt AS (SELECT query_id, {Q.trimmed('x')} AS x FROM (SELECT query_id, unnest(regexp_extract_all(
   {_plain('text')}, {NAME}, 1)) AS x FROM p WHERE category = 'en')),
 td AS (SELECT query_id, list_sort(list(DISTINCT x))[1:8] AS t FROM tt
   WHERE len(x) BETWEEN 3 AND 30 GROUP BY query_id),
 g AS (SELECT rs.query_id, symptoms AS s, coalesce(c, []) AS c, coalesce(t, []) AS t FROM rs
   LEFT JOIN cd USING (query_id) LEFT JOIN td USING (query_id))"""


def _layer(col: str, n: int, prefix: str, kind: str) -> str:
    return f"""SELECT query_id, '{prefix}' || (generate_subscripts({col}[1:{n}], 1) - 1) AS id,
 unnest({col}[1:{n}]) AS label, '{kind}' AS type FROM g"""


NODE_SQL = f"""WITH {PASSAGES}, {GRAPH} {_layer('s', 10, 'sym_', 'symptom')} UNION ALL
{_layer('c', 8, 'cond_', 'condition')} UNION ALL {_layer('t', 8, 'treat_', 'treatment')}"""
EDGES = """i AS (SELECT query_id, unnest(range(least(5, len(s)))) AS i FROM g),
 j AS (SELECT query_id, unnest(range(least(5, len(c)))) AS j FROM g),
 k AS (SELECT query_id, unnest(range(least(5, len(t)))) AS k FROM g),
 ed AS (SELECT query_id, 'sym_' || i AS source, 'cond_' || j AS target, 'suggests' AS label FROM i JOIN j USING (query_id)
   UNION ALL SELECT query_id, 'cond_' || j, 'treat_' || k, 'managed_by' FROM j JOIN k USING (query_id))"""
EDGE_SQL = f"WITH {PASSAGES}, {GRAPH}, {EDGES} SELECT * FROM ed"
PACKAGE_SQL = f"""WITH {PASSAGES}, {GRAPH}, {_keys('q', 25, 'k')}, {KA}, {PM},
 al AS (SELECT query_id, round(len(m) / len(keys), 3) AS support, row_number() OVER (PARTITION BY query_id
   ORDER BY round(len(m) / len(keys), 3) DESC, rank) AS place FROM pm QUALIFY place <= 5),
 ev AS (SELECT query_id, count(*)::INT AS evidence_count, max(support) AS best_support FROM al GROUP BY query_id),
 {_keys('q', 20, 'k20')}, ka20 AS (SELECT query_id, list(keyword ORDER BY place) AS keys FROM k20 GROUP BY query_id),
 pm20 AS (SELECT p.query_id, list_filter(ka20.keys, lambda x: contains(lower({Q.squeezed('p.text')}), x)) AS m
   FROM p JOIN ka20 USING (query_id)),
 sn AS (SELECT query_id, len(list_distinct(flatten(list(m)))) AS seen FROM pm20 GROUP BY query_id),
 sp AS (SELECT query_id, string_split(regexp_replace({Q.trimmed('text')},
   '([.!?])[ \\t\\n\\x0b\\x0c\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM q),
 sx AS (SELECT query_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM sp),
 fs AS (SELECT query_id, {Q.trimmed('s')} AS first_sentence FROM (SELECT *, CASE WHEN len(s) > 12 THEN {MARK_Q} ELSE 0 END AS w FROM sx)
   QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, i) = 1)
SELECT q.query_id, CASE WHEN ka20.keys IS NULL THEN 0.5 ELSE round(greatest(0.3e0, least(0.92e0,
  0.45e0 + 0.45e0 * (coalesce(seen, 0) / len(ka20.keys)) - CASE WHEN q.query_id % 3 = 0 THEN 0.1e0 ELSE 0 END)), 3)
  END::DOUBLE AS confidence, coalesce(evidence_count, 0) AS evidence_count, best_support,
 {Q.lit(L.COUNTERFACTUAL_GENERIC)} AS last_counterfactual, first_sentence,
 (least(10, len(g.s)) + len(g.c) + len(g.t))::INT AS nodes,
 (least(5, len(g.c)) * (least(5, len(g.s)) + least(5, len(g.t))))::INT AS edges
FROM q JOIN g USING (query_id) LEFT JOIN ka20 USING (query_id) LEFT JOIN sn USING (query_id) LEFT JOIN ev USING (query_id) LEFT JOIN fs USING (query_id)"""
CORPUS = f"""dc AS (SELECT doc_id, text, lang FROM documents), {_symptom_ctes('dc', 'doc_id')},
 cd AS (SELECT doc_id, list_sort(list(DISTINCT x))[1:8] AS c FROM (SELECT doc_id, {Q.trimmed('x')} AS x FROM (SELECT doc_id,
   unnest(regexp_extract_all({_plain('text')}, {PHRASE}, 1)) AS x FROM dc)) WHERE len(x) BETWEEN 3 AND 32 GROUP BY doc_id),
 td AS (SELECT doc_id, list_sort(list(DISTINCT x))[1:8] AS t FROM (SELECT doc_id, {Q.trimmed('x')} AS x FROM (SELECT doc_id,
   unnest(regexp_extract_all({_plain('text')}, {NAME}, 1)) AS x FROM dc WHERE lang = 'en')) WHERE len(x) BETWEEN 3 AND 30 GROUP BY doc_id),
 l AS (SELECT doc_id, 'symptom' AS type, unnest(symptoms[1:10]) AS label, generate_subscripts(symptoms[1:10], 1) AS n FROM rs
   UNION ALL SELECT doc_id, 'condition', unnest(c), generate_subscripts(c, 1) FROM cd
   UNION ALL SELECT doc_id, 'treatment', unnest(t), generate_subscripts(t, 1) FROM td),
 n AS (SELECT *, type || '_' || substr(md5(lower(label)), 1, 12) AS id FROM l)"""
CORPUS_NODE_SQL = f"""WITH {CORPUS} SELECT id, type, min(label) AS label, count(DISTINCT doc_id) AS passages FROM n GROUP BY ALL"""
CORPUS_EDGE_SQL = f"""WITH {CORPUS} SELECT a.id AS source, b.id AS target,
 CASE a.type WHEN 'symptom' THEN 'suggests' ELSE 'managed_by' END AS label, count(DISTINCT a.doc_id) AS weight
FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.n <= 5 AND b.n <= 5
 AND (a.type = 'symptom' AND b.type = 'condition' OR a.type = 'condition' AND b.type = 'treatment') GROUP BY ALL"""
PCOND_SQL = f"""WITH {PASSAGES}, x AS (SELECT query_id, {Q.trimmed('x')} AS x FROM (SELECT query_id,
   unnest(regexp_extract_all({_plain('text')}, {Q.lit(chr(92) + 'b' + L.CONDITION_PHRASE_PATTERN + chr(92) + 'b')}, 1)) AS x
   FROM p WHERE rank <= 3)),
 d AS (SELECT query_id, list_sort(list(DISTINCT x))[1:8] AS c FROM x WHERE len(x) BETWEEN 3 AND 32 GROUP BY query_id)
SELECT query_id, (generate_subscripts(c, 1) - 1)::INT AS position, unnest(c) AS condition FROM d"""


# --- replies --------------------------------------------------------------

def reply_light_cleanup(spark, sf):
    return reply_texts(spark, sf).select("reply_id", X.light_cleanup(F.col("text")).alias("text"))


def reply_heavy_cleanup(spark, sf):
    return reply_texts(spark, sf).select(
        "reply_id", X.heavy_cleanup(F.col("text"), collapse_repeats=False).alias("text"))


def reply_repeat_collapse(spark, sf):
    doubled = F.concat("text", F.lit(" "), F.repeat(F.lit("again and again "), 3))
    return reply_texts(spark, sf).select("reply_id", X.heavy_cleanup(doubled).alias("text"))


def reply_filler_closer(spark, sf):
    return reply_texts(spark, sf).select(
        "reply_id", X.strip_filler_closer(F.col("text")).alias("text"))


def reply_labels(spark, sf):
    c = F.col("text")
    return reply_texts(spark, sf).select(
        "reply_id", X.hypothetical_specific(c).alias("specific"),
        X.hypothetical_broad(c).alias("broad"), X.summary_title(c).alias("title"),
        X.summary_body(c).alias("overview"), X.generated_context(c).alias("context"))


def reply_sections(spark, sf):
    return replies.sections(reply_texts(spark, sf))


def reply_json_draft(spark, sf):
    fields = safety.parse_draft(F.col("text"))
    return reply_texts(spark, sf).select("reply_id", *[v.alias(k) for k, v in fields.items()])


def reply_opening_echo(spark, sf):
    """Replies that start with the previous reply of the conversation."""
    log = table(spark, sf, "conversations")
    both = conversation.previous_text(log, "assistant", "before").filter("role = 'assistant'")
    echoed = F.when((F.col("conv_id") % 2 == 0) & F.col("before").isNotNull(), F.concat(
        "before", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    return both.select("conv_id", "turn", replies.strip_opening_echo(
        echoed, X.or_empty(F.col("before"))).alias("text"))


def finding_labels(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in (
        "Effusion", "Pleural_Thickening", "lung_lesion", "Lung Lesion", "old fracture")]),
        (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey", X.pretty_label(raw).alias("label"),
        F.round((F.col("p_size") % 50) / 50, 4).alias("probability"))


def _json_field(x: str, keys) -> str:
    picks = ", ".join(f"nullif({Q.trimmed(f'(x->>{Q.lit(chr(36) + chr(46) + k)})')}, '')" for k in keys)
    return picks.replace("x->>", f"CASE WHEN json_valid({x}) THEN {x} END->>")


LT = Q.trimmed("text")
LIGHT_SQL = f"""WITH {REPLIES}, a AS (SELECT reply_id, {LT} AS t FROM rp),
 b AS (SELECT reply_id, coalesce(CASE WHEN regexp_matches(t, '(?s)^\\s*\\{{.*\\}}\\s*$') THEN
   coalesce({_json_field('t', ['medical_assessment', 'answer', 'response', 'summary'])}) END, t) AS t FROM a),
 c AS (SELECT reply_id, regexp_replace(regexp_replace(t,
   '(?i)^"?(?:medical_assessment|answer|response)"?\\s*:\\s*"?', ''),
   '(?i)^(?:Response:|Answer:|Medical Assessment:)\\s*', '') AS t FROM b),
 d AS (SELECT reply_id, {Q.trimmed("regexp_replace(t, chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS t FROM c),
 e AS (SELECT reply_id, CASE WHEN len(t) > 1 AND starts_with(t, '"') AND ends_with(t, '"')
   THEN {Q.trimmed('substr(t, 2, len(t) - 2)')} ELSE t END AS t FROM d)
SELECT reply_id, regexp_replace(t, '!+', '.', 'g') AS text FROM e"""
HEAVY_SQL = f"""WITH {REPLIES}, a AS (SELECT reply_id, {LT} AS raw, regexp_replace(regexp_replace({LT},
   '^"?medical_assessment"?:\\s*"?', ''), '^"?[a-z_]+"?:\\s*"?', '') AS t FROM rp),
 b AS (SELECT reply_id, raw, coalesce(CASE WHEN regexp_matches(t, '(?s)^\\s*\\{{.*\\}}\\s*$') THEN
   coalesce({_json_field('t', ['medical_assessment', 'answer', 'response', 'summary', 'condition_summary', 'diagnosis'])}) END, t) AS t FROM a),
 c AS (SELECT reply_id, raw, regexp_replace(t,
   '(?i)^(?:Return structured JSON response:|Response:|Answer:|Medical Assessment:)\\s*', '') AS t FROM b),
 d AS (SELECT reply_id, raw, regexp_replace(regexp_replace(regexp_replace(t, '```[^`]*```', '', 'g'),
   '\\*\\*([^\\n]*?)\\*\\*', '\\1', 'g'), '\\*([^\\n]*?)\\*', '\\1', 'g') AS t FROM c),
 e AS (SELECT reply_id, raw, regexp_replace({Q.squeezed('t')}, '^"+|"+$', '', 'g') AS t FROM d)
SELECT reply_id, CASE WHEN t = '' THEN substr({Q.squeezed('raw')}, 1, 2000) ELSE t END AS text FROM e"""
FILLER_SQL = f"""WITH {REPLIES}, a AS (SELECT reply_id, text, regexp_replace(text, {Q.lit(X.WS + '+$')}, '') AS body FROM rp),
 b AS (SELECT *, len(regexp_extract(body, {Q.lit('(?s)^(.*[.!?]' + X.WS + '+)')}, 1)) AS st FROM a),
 c AS (SELECT *, lower(substr(body, st + 1)) AS last, regexp_replace(substr(body, 1, st), {Q.lit(X.WS + '+$')}, '') AS kept FROM b)
SELECT reply_id, CASE WHEN {Q.contains_any('last', L.FILLER_CLOSERS)} AND {Q.word_count('kept')} >= 8
 THEN kept ELSE text END AS text FROM c"""


def _label(name: str) -> str:
    return Q.trimmed(f"regexp_extract(text, '(?i){name}\\s*:\\s*([^\\n]+)', 1)")


LABEL_SQL = f"""WITH {REPLIES}, a AS (SELECT reply_id, text, {_label('SPECIFIC')} AS sp, {_label('BROAD')} AS br,
  {_label('TITLE')} AS ti, nullif(regexp_extract(text, '(?is)OVERVIEW\\s*:\\s*(.+)', 1), '') AS ov,
  {Q.squeezed('''regexp_replace(regexp_replace(regexp_replace(text, '(?i)(^|[^a-zA-Z0-9_])(specific|broad)\\s*:\\s*', '\\1 ', 'g'),
  '(?is)^.*?\\basks?\\s*:\\s*"[^"]*"\\s*[.,:;-]*', ''), '(?i)^\\s*(specifically|in general)[,:]?\\s*', '')''')} AS pl,
  replace({LT}, chr(10), ' ') AS fl FROM rp)
SELECT reply_id, coalesce(CASE WHEN len(sp) > 15 THEN substr(sp, 1, 400) END,
  CASE WHEN len(pl) > 25 THEN substr(pl, 1, 400) END) AS specific,
 CASE WHEN len(br) > 15 THEN substr(br, 1, 400) END AS broad, substr(ti, 1, 80) AS title,
 substr({Q.squeezed('coalesce(ov, text)')}, 1, 1500) AS overview,
 substr(CASE WHEN contains(fl, '</think>') THEN {Q.trimmed("string_split(fl, '</think>')[-1]")} ELSE fl END, 1, 240) AS context
FROM a"""
SECTION_SQL = f"""WITH {REPLIES}, ln AS (SELECT reply_id, no, {Q.trimmed('l')} AS line FROM (SELECT reply_id,
   unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM rp)
   WHERE {Q.trimmed('l')} <> ''),
 hd AS (SELECT *, CASE WHEN {Q.contains_any('lower(line)', L.SECTION_ASSESSMENT)} THEN 'A'
   WHEN {Q.contains_any('lower(line)', L.SECTION_RECOMMENDATION)} THEN 'R'
   WHEN {Q.contains_any('lower(line)', L.SECTION_EDUCATION)} THEN 'E'
   WHEN {Q.contains_any('lower(line)', L.SECTION_WARNING)} THEN 'W' END AS head FROM ln),
 sc AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER w, 'A') AS section,
   count(*) FILTER (head IN ('A', 'E')) OVER w AS part FROM hd
   WINDOW w AS (PARTITION BY reply_id ORDER BY no ROWS UNBOUNDED PRECEDING)),
 gt AS (SELECT reply_id, part, string_agg(line, ' ' ORDER BY no) FILTER
   ((head IS NULL AND section IN ('A', 'E')) OR head = 'E') AS t,
   max_by(section, no) AS last_section, max_by(head, no) FILTER (head IN ('A', 'E')) AS opened
   FROM sc GROUP BY ALL),
 nx AS (SELECT *, lead(opened) OVER v AS nx, lead(part) OVER v IS NULL AS final FROM gt
   WINDOW v AS (PARTITION BY reply_id ORDER BY part)),
 fa AS (SELECT reply_id, max_by(t, part) FILTER (t <> '' AND (nx = 'A' OR (final AND last_section = 'A'))) AS assessment,
   max_by(t, part) FILTER (t <> '' AND final AND last_section = 'E') AS education FROM nx GROUP BY reply_id),
 li AS (SELECT reply_id, string_agg(line, chr(10) ORDER BY no) FILTER ((head IS NULL AND section = 'R') OR (head = 'R'
   AND NOT (starts_with(lower(line), 'recommend') OR starts_with(lower(line), 'treatment') OR starts_with(lower(line), 'management')))) AS recommendations,
   string_agg(line, chr(10) ORDER BY no) FILTER (head = 'W') AS warnings FROM sc GROUP BY reply_id)
SELECT rp.reply_id, coalesce(nullif(assessment, ''), CASE WHEN len(text) > 500 THEN substr(text, 1, 500) || '...'
 ELSE text END) AS assessment, coalesce(education, '') AS education,
 coalesce(recommendations, '') AS recommendations, coalesce(warnings, '') AS warnings
FROM rp LEFT JOIN fa USING (reply_id) LEFT JOIN li USING (reply_id)"""
JB = "nullif(regexp_extract(text, '(?s)(\\{.*\\})', 1), '')"
CHECKS = "[" + ",".join(f'"{c}"' for c in L.DRAFT_CHECKS) + "]"


def _draft_field(name: str, default: str) -> str:
    return f"coalesce(CASE WHEN json_valid(j) THEN j->>'$.{name}' END, {Q.lit(default)}) AS {name}"


DRAFT_SQL = f"""WITH {REPLIES}, a AS (SELECT reply_id, {JB} AS j FROM rp)
SELECT reply_id, 'DRAFT' AS status, {_draft_field('candidate_drugs', '[]')},
 {_draft_field('checks_to_run', CHECKS)}, {_draft_field('sources', '[]')} FROM a"""
LABELS_SQL = """SELECT p_partkey, (['Pleural effusion', 'Pleural thickening', 'Lung Lesion', 'Lung lesion',
 'Old Fracture'])[p_partkey % 5 + 1] AS label, round((p_size % 50) / 50, 4) AS probability FROM part"""


# --- safety ---------------------------------------------------------------

def _interactions(spark, sf):
    """User messages with a derived confidence and source count."""
    u = U.utterances(spark, sf).filter("role = 'user'")
    return u.select(
        "conv_id", "turn", F.concat(F.lit("t"), "turn").alias("ts"),
        F.concat(F.lit("s"), F.col("conv_id") % 20).alias("session_id"),
        F.col("text").alias("query"),
        F.when(F.col("turn") % 4 < 3, ((F.col("conv_id") * 7 + F.col("turn")) % 10) / 10.0)
        .alias("confidence"),
        (F.size(safety.audit_emergencies(F.col("text"))) > 0).alias("emergency"),
        (F.col("conv_id") % 5).alias("sources"))


def interaction_log(spark, sf):
    return safety.interaction_log(_interactions(spark, sf))


def risk_analysis(spark, sf):
    i = _interactions(spark, sf)
    order = ["conv_id", "turn"]
    counted = safety.session_volume(i, ["session_id"], order, F.floor(F.col("conv_id") / 20))
    return safety.risks(counted, max_queries=10).select(
        "conv_id", "turn", "session_count", "risk_level", "risk_factors", "requires_review")


def suspicious_counts(spark, sf):
    return U.utterances(spark, sf).select(
        "conv_id", "turn", safety.suspicious_count(F.col("text")).alias("suspicious"))


def _events(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), "event_id", "ts",
        F.least(F.col("value") / 50.0, F.lit(1.0)).alias("confidence"),
        (F.col("event_type") == "error").alias("emergency"))


def session_summary(spark, sf):
    return safety.session_summary(_events(spark, sf))


def session_running_count(spark, sf):
    """Running volume per user; time slices keep a hot user parallel."""
    e = _events(spark, sf)
    counted = running_count(e, ["session_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"),
                            "session_count")
    return counted.select("event_id", "session_id", "session_count",
                          (F.col("session_count") > L.MAX_QUERIES_PER_SESSION).alias("over_limit"))


def _responses(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select(
        "doc_id", (F.col("toxic") == 1).alias("error"), (F.col("n_chars") > 500).alias("has_summary"),
        (F.col("doc_id") % 3 == 0).alias("has_conditions"), (F.col("doc_id") % 4 < 2).alias("has_actions"),
        (F.col("lang") == "en").alias("has_disclaimer"), F.col("quality").isNotNull().alias("has_truth"),
        ((F.col("doc_id") % 11) / 10.0).alias("confidence"), (F.col("doc_id") % 6).alias("sources_used"))


def response_scores(spark, sf):
    return safety.response_scores(_responses(spark, sf)).select("doc_id", "accuracy", *[
        F.round(n, 6).alias(n) for n in safety.SCORE_NAMES])


def evaluation_summary(spark, sf):
    return safety.evaluation_summary(safety.response_scores(_responses(spark, sf)))


def interaction_record(spark, sf):
    """Every benchmark query as an interaction of one of four sessions; every ninth got no answer."""
    q, p = queries(spark, sf), passages(spark, sf)

    def some(kind):
        return F.exists("nodes", lambda n: n["type"] == kind)

    rows = (q.join(explain.confidence(q, p, F.lit("LOW")), "query_id").join(graph.of_queries(q, p, DRUGS), "query_id")
            .join(p.groupBy("query_id").agg(F.count("*").alias("sources")), "query_id", "left")
            .select("query_id", F.col("text").alias("query"), "text", F.concat(F.lit("t"), F.lpad(F.col("query_id").cast("string"), 9, "0")).alias("ts"),
                    F.when(F.col("query_id") % 5 < 4, F.concat(F.lit("s"), F.col("query_id") % 5)).alias("session_id"), "confidence", "sources",
                    F.lit(False).alias("error"), (F.length("text") > 200).alias("has_summary"), some("condition").alias("has_conditions"),
                    some("treatment").alias("has_actions"), (F.col("query_id") % 2 == 0).alias("has_disclaimer")))
    lost = F.col("query_id") % 9 == 8
    both = rows.filter(~lost).unionByName(safety.fallback(rows.filter(lost)))
    return safety.interactions(both, p, F.floor(F.col("query_id") / 8), max_queries=5)


def source_alignment(spark, sf):
    return safety.source_alignment(queries(spark, sf), passages(spark, sf))


def clinical_checks(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return safety.clinical_checks(e.select(
        "event_id", (k % 10 == 0).alias("allergy_conflict"), (k % 17 == 0).alias("contraindicated"),
        F.when(k % 13 == 0, "severe").when(k % 5 == 0, "mild").alias("interaction_severity"),
        (F.col("event_type") == "purchase").alias("formulary_restricted"),
        F.lit(None).cast("boolean").alias("prior_authorisation"))).select(
        "event_id", "block", "requires_override")


AUDIT_TERMS = [t for _, t in L.flatten(L.AUDIT_EMERGENCY_KEYWORDS)]
INTER = f"""{U.SQL}, it AS (SELECT conv_id, turn, 't' || turn AS ts, 's' || (conv_id % 20) AS session_id, text AS query,
  CASE WHEN turn % 4 < 3 THEN ((conv_id * 7 + turn) % 10) / 10e0 END AS confidence,
  {Q.contains_any('lower(text)', AUDIT_TERMS)} AS emergency, conv_id % 5 AS sources FROM u WHERE role = 'user')"""
LOG_SQL = f"""WITH {INTER} SELECT substr(md5(ts || '_' || substr(query, 1, 50)), 1, 12) AS interaction_id, ts, session_id,
 md5(query) AS query_hash, len(query)::INT AS query_length, coalesce(confidence, 0) AS response_confidence,
 emergency AS emergency_detected, sources AS sources_used FROM it"""
SUSP = " + ".join(f"contains(lower({{c}}), {Q.lit(t)})::INT" for t in L.SUSPICIOUS_INDICATORS)
RISK_SQL = f"""WITH {INTER}, c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY conv_id, turn) AS n,
   coalesce(confidence, 0) < 0.3e0 AS low, ({SUSP.format(c='query')}) >= 5 AS odd FROM it)
SELECT conv_id, turn, n AS session_count, CASE WHEN emergency THEN 'critical' WHEN odd THEN 'high'
 WHEN low THEN 'medium' ELSE 'low' END AS risk_level, array_to_string(list_filter([
 CASE WHEN emergency THEN 'emergency' END, CASE WHEN low THEN 'low_confidence' END,
 CASE WHEN n > 10 THEN 'high_volume' END, CASE WHEN odd THEN 'suspicious' END], lambda f: f IS NOT NULL), ',') AS risk_factors,
 emergency OR n > 10 OR odd AS requires_review FROM c"""
SUSP_SQL = f"WITH {U.SQL} SELECT conv_id, turn, {SUSP.format(c='text')} AS suspicious FROM u"
EV = """e AS (SELECT user_id AS session_id, event_id, ts, least(value / 50e0, 1e0) AS confidence,
  event_type = 'error' AS emergency FROM events)"""
SESSION_SQL = f"""WITH {EV} SELECT session_id, count(*) AS total_queries, count(*) FILTER (emergency) AS emergencies,
 round(avg(confidence), 6) AS average_confidence, min(ts) AS session_start, max(ts) AS session_end,
 CASE WHEN count(*) FILTER (emergency) = 0 AND round(avg(confidence), 9) > 0.5e0 THEN 'safe' ELSE 'needs_review' END AS status
FROM e GROUP BY session_id"""
RUNNING_SQL = f"""WITH {EV} SELECT event_id, session_id, row_number() OVER w AS session_count,
 row_number() OVER w > 50 AS over_limit FROM e WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)"""
RESP = """r AS (SELECT d.doc_id, coalesce(toxic = 1, false) AS error, (n_chars > 500)::INT AS s, (d.doc_id % 3 = 0)::INT AS c,
  (d.doc_id % 4 < 2)::INT AS a, (lang = 'en')::INT AS dis, quality IS NOT NULL AS truth,
  (d.doc_id % 11) / 10e0 AS confidence, d.doc_id % 6 AS src FROM documents d LEFT JOIN labels USING (doc_id)),
 sc AS (SELECT *, CASE WHEN error THEN 0 ELSE (s + c + a) / 3e0 * 0.5e0 + confidence * 0.3e0 + least(src / 3e0, 1e0) * 0.2e0 END AS relevance,
  CASE WHEN error THEN 0 ELSE (s + c + a + dis) / 4e0 END AS completeness,
  CASE WHEN confidence > 0.8e0 THEN 0.8e0 ELSE 1e0 END AS safety,
  CASE WHEN error THEN 0 ELSE (greatest(c, a) + s) / 2e0 END AS clarity FROM r),
 ov AS (SELECT *, CASE WHEN truth THEN (relevance + completeness + safety + clarity + 0.5e0) / 5e0
  ELSE (relevance + completeness + safety + clarity) / 4e0 END AS overall FROM sc)"""
SCORE_SQL = f"""WITH {RESP} SELECT doc_id, CASE WHEN truth THEN 0.5e0 END AS accuracy, {', '.join(
    f'round({n}, 6) AS {n}' for n in safety.SCORE_NAMES)} FROM ov"""
EVAL_SQL = f"""WITH {RESP} SELECT count(*) AS total, {', '.join(
    f'round(avg({n}), 6) AS avg_{n}, round(stddev_pop({n}), 6) AS std_{n}' for n in safety.SCORE_NAMES)} FROM ov"""
ALIGNMENT_SQL = f"""WITH {PASSAGES}, sd AS (SELECT query_id, unnest({Q.words('lower(text)')}) AS w FROM q),
 kn AS (SELECT DISTINCT query_id, unnest({Q.words('lower(text)')}) AS w FROM p),
 n AS (SELECT query_id, count(*) AS common FROM sd SEMI JOIN (SELECT * FROM kn WHERE len(w) > 4) USING (query_id, w) GROUP BY query_id)
SELECT q.query_id, coalesce(common, 0) AS common, CASE WHEN coalesce(common, 0) > 10 THEN 'excellent'
 WHEN coalesce(common, 0) > 5 THEN 'good' ELSE 'moderate' END AS alignment FROM q LEFT JOIN n USING (query_id)"""
RECORD_SQL = f"""WITH {PASSAGES}, {GRAPH}, {_keys('q', 20, 'k')}, {KA}, {PM},
 sn AS (SELECT query_id, len(list_distinct(flatten(list(m)))) AS seen FROM pm GROUP BY query_id),
 cf AS (SELECT q.query_id, CASE WHEN keys IS NULL THEN 0.5e0 ELSE round(greatest(0.3e0, least(0.92e0,
   0.45e0 + 0.45e0 * (coalesce(seen, 0) / len(keys)))), 3) END AS confidence FROM q LEFT JOIN ka USING (query_id) LEFT JOIN sn USING (query_id)),
 np AS (SELECT query_id, count(*) AS sources FROM p GROUP BY query_id),
 it AS (SELECT q.query_id, q.text AS query, 't' || lpad(q.query_id::VARCHAR, 9, '0') AS ts,
   CASE WHEN q.query_id % 5 < 4 THEN 's' || (q.query_id % 5) ELSE 'anonymous' END AS session_id, q.query_id % 9 = 8 AS error,
   CASE WHEN q.query_id % 9 = 8 THEN 0e0 ELSE confidence END AS confidence, CASE WHEN q.query_id % 9 = 8 THEN 0 ELSE sources END AS sources,
   (len(q.text) > 200)::INT AS s, (len(g.c) > 0)::INT AS c, (len(g.t) > 0)::INT AS a, (q.query_id % 2 = 0)::INT AS dis,
   {Q.contains_any('lower(q.text)', AUDIT_TERMS)} AS emergency
   FROM q JOIN cf USING (query_id) JOIN g USING (query_id) LEFT JOIN np USING (query_id)),
 ct AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, query_id) AS n, confidence < 0.3e0 AS low,
   ({SUSP.format(c='query')}) >= 5 AS odd,
   CASE WHEN error THEN 0e0 ELSE (s + c + a) / 3e0 * 0.5e0 + confidence * 0.3e0 + least(coalesce(sources, 0) / 3e0, 1e0) * 0.2e0 END AS relevance,
   CASE WHEN error THEN 0e0 ELSE (s + c + a + dis) / 4e0 END AS completeness, CASE WHEN confidence > 0.8e0 THEN 0.8e0 ELSE 1e0 END AS safety,
   CASE WHEN error THEN 0e0 ELSE (greatest(c, a) + s) / 2e0 END AS clarity FROM it),
 sd AS (SELECT query_id, unnest({Q.words('lower(text)')}) AS w FROM q),
 kn AS (SELECT DISTINCT query_id, unnest({Q.words('lower(text)')}) AS w FROM p),
 cm AS (SELECT query_id, count(*) AS common FROM sd SEMI JOIN (SELECT * FROM kn WHERE len(w) > 4) USING (query_id, w) GROUP BY query_id),
 ci AS (SELECT query_id, list('Reference [' || (rank - 1) || ']: ' || source ORDER BY rank) AS citations FROM p WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, substr(md5(ts || '_' || substr(query, 1, 50)), 1, 12) AS interaction_id, ts, session_id, md5(query) AS query_hash,
 len(query)::INT AS query_length, confidence AS response_confidence, emergency AS emergency_detected, coalesce(sources, 0) AS sources_used,
 n AS session_count, CASE WHEN emergency THEN 'critical' WHEN odd THEN 'high' WHEN low THEN 'medium' ELSE 'low' END AS risk_level,
 array_to_string(list_filter([CASE WHEN emergency THEN 'emergency' END, CASE WHEN low THEN 'low_confidence' END,
   CASE WHEN n > 5 THEN 'high_volume' END, CASE WHEN odd THEN 'suspicious' END], lambda f: f IS NOT NULL), ',') AS risk_factors,
 emergency OR n > 5 OR odd AS requires_review, round(relevance, 6) AS relevance, round(completeness, 6) AS completeness,
 round(safety, 6) AS safety, round(clarity, 6) AS clarity, round((relevance + completeness + safety + clarity) / 4e0, 6) AS overall,
 coalesce(common, 0) AS common, CASE WHEN coalesce(common, 0) > 10 THEN 'excellent' WHEN coalesce(common, 0) > 5 THEN 'good' ELSE 'moderate' END AS alignment,
 citations FROM ct LEFT JOIN cm USING (query_id) LEFT JOIN ci USING (query_id)"""
CLINICAL_SQL = """WITH e AS (SELECT event_id, event_type, (props->>'$.k')::INT AS k FROM events)
SELECT event_id, k % 10 = 0 OR k % 17 = 0 AS block, k % 13 = 0 OR event_type = 'purchase' AS requires_override FROM e"""

REGISTRY = {
    "budget_fill": (budget_fill, BUDGET_SQL),
    "subtopic_coverage": (subtopic_coverage, COVER_SQL),
    "coverage_summary": (coverage_summary, COVER_SUM_SQL),
    "overview_union": (overview_union, OVERVIEW_SQL),
    "evidence_block": (evidence_block, BLOCK_SQL),
    "reference_list": (reference_list, REFS_SQL),
    "literature_block": (literature_block, LIT_SQL),
    "citation_list": (citation_list, CITE_SQL),
    "query_sources": (query_sources, QSRC_SQL),
    "prompt_compose": (prompt_compose, COMPOSE_SQL),
    "prompt_truncate": (prompt_truncate, TRUNCATE_SQL),
    "medication_draft_references": (medication_draft_references, DRAFT_REF_SQL),
    "document_keywords": (document_keywords, KEYWORD_SQL),
    "evidence_alignment": (evidence_alignment, ALIGN_SQL),
    "explanation_confidence": (explanation_confidence, CONF_SQL),
    "explanation_package": (explanation_package, PACKAGE_SQL),
    "reasoning_outline": (reasoning_outline, OUTLINE_SQL),
    "counterfactuals": (counterfactuals, COUNTER_SQL),
    "graph_nodes": (graph_nodes, NODE_SQL),
    "graph_edges": (graph_edges, EDGE_SQL),
    "corpus_graph_nodes": (corpus_graph_nodes, CORPUS_NODE_SQL),
    "corpus_graph_edges": (corpus_graph_edges, CORPUS_EDGE_SQL),
    "passage_conditions": (passage_conditions, PCOND_SQL),
    "reply_light_cleanup": (reply_light_cleanup, LIGHT_SQL),
    "reply_heavy_cleanup": (reply_heavy_cleanup, HEAVY_SQL),
    "reply_repeat_collapse": (reply_repeat_collapse, None),
    "reply_filler_closer": (reply_filler_closer, FILLER_SQL),
    "reply_labels": (reply_labels, LABEL_SQL),
    "reply_sections": (reply_sections, SECTION_SQL),
    "reply_json_draft": (reply_json_draft, DRAFT_SQL),
    "reply_opening_echo": (reply_opening_echo, None),
    "finding_labels": (finding_labels, LABELS_SQL),
    "interaction_log": (interaction_log, LOG_SQL),
    "risk_analysis": (risk_analysis, RISK_SQL),
    "suspicious_counts": (suspicious_counts, SUSP_SQL),
    "session_summary": (session_summary, SESSION_SQL),
    "session_running_count": (session_running_count, RUNNING_SQL),
    "response_scores": (response_scores, SCORE_SQL),
    "evaluation_summary": (evaluation_summary, EVAL_SQL),
    "source_alignment": (source_alignment, ALIGNMENT_SQL),
    "interaction_record": (interaction_record, RECORD_SQL),
    "clinical_checks": (clinical_checks, CLINICAL_SQL),
}
