"""Queries that classify messages and extract signals from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensmere.functions import lexicons as L
from lensmere.functions import text as X
from lensmere.operators import gates, models, symptoms, terms
from lensmere.plans import sql as Q
from lensmere.plans import utterances as U
from lensmere.session import new_folder
from lensmere.tables import spread, table

KEY = ["conv_id", "turn"]


def _u(spark, sf):
    return U.utterances(spark, sf)


def _words_of(*phrases: str) -> list:
    return sorted({w for p in phrases for w in p.split() if len(w) >= 4 and w not in L.INDEX_STOPWORDS})


# The gate's vocabulary is a table; this one has the longer words of the other lexicons.
VOCABULARY = _words_of(*L.HEALTHCARE_TERMS, *(t for x in (L.SYMPTOM_KEYWORDS, L.SPECIALTIES) for _, t in L.flatten(x)))


def _vocabulary(spark) -> list:
    """The terms as the gate reads them: from a table given by path."""
    path = new_folder(spark, "vocabulary")
    spark.createDataFrame([(w,) for w in VOCABULARY], "term string").write.parquet(path)
    return terms.vocabulary(spark, path)


def scope_classify(spark, sf):
    image = (F.col("conv_id") % 13 == 0) & (F.col("turn") == 0)
    return gates.scope(_u(spark, sf), has_image=image, in_conversation=F.col("turn") > 0,
                       vocabulary=_vocabulary(spark), embedder=models.hashing_embedder()).select(
        *KEY, "kind", "confidence", "reason")


def scope_heuristics(spark, sf):
    """Kinds by role without the embedding tiebreak."""
    g = gates.scope(_u(spark, sf), in_conversation=F.col("turn") > 0, vocabulary=_vocabulary(spark))
    return g.groupBy("role", "kind", "reason").agg(F.count("*").alias("n"))


def vocabulary_mentions(spark, sf):
    """Every occurrence of the benchmark's longer words in the documents, by document.

    Words that begin as they end are left out: SQL finds no occurrences that overlap.
    """
    words = table(spark, sf, "benchmark").select(F.explode(X.index_tokens(F.col("text"))).alias("term")).filter("length(term) >= 5")
    words = words.filter("not exists(sequence(1, length(term) - 1), k -> left(term, k) = right(term, k))")
    path = new_folder(spark, "vocabulary")
    words.distinct().write.parquet(path)
    found = terms.mentions(spread(table(spark, sf, "documents").select("doc_id", "text")), spark.read.parquet(path))
    return found.groupBy("doc_id").agg(F.count("*").alias("mentions"), F.count_distinct("term").alias("terms"),
                                       F.sum("start").alias("places"), F.max("start").alias("last"))


def anchor_tiebreak(spark, sf):
    u = _u(spark, sf).withColumn("v", models.hashing_embedder()(F.col("text")))
    med = gates.nearest_anchor(L.MEDICAL_ANCHORS)(F.col("v"))
    non = gates.nearest_anchor(L.OTHER_ANCHORS)(F.col("v"))
    return u.select(*KEY, F.round(med, 6).alias("medical"), F.round(non, 6).alias("other"))


def query_classes(spark, sf):
    c = F.col("text")
    return _u(spark, sf).select(
        *KEY, gates.query_type(c, F.size(symptoms.rule_entities(c))).alias("query_type"),
        gates.complexity(c).alias("complexity"), gates.intent(c).alias("intent"),
        gates.retrieval_arm(gates.complexity(c)).alias("arm"))


def token_budget(spark, sf):
    c = F.col("text")
    return _u(spark, sf).select(
        *KEY, gates.token_budget(c, gates.complexity(c), F.length(c)).alias("max_tokens"))


def specialty_tags(spark, sf):
    c = F.col("text")
    return _u(spark, sf).select(*KEY, F.array_join(gates.specialties(c), ",").alias("specialties"))


def conversational_predicates(spark, sf):
    c = F.col("text")
    return _u(spark, sf).select(
        *KEY, gates.is_smalltalk(c).alias("smalltalk"), gates.is_identity(c).alias("identity"),
        gates.is_healthcare(c).alias("healthcare"), gates.greeting_tone(c).alias("tone"),
        gates.asks_for_sources(c).alias("asks_sources"),
        F.array_join(gates.interaction_flags(c), ",").alias("interaction_flags"))


def disclaimer_choice(spark, sf):
    c = F.col("text")
    return _u(spark, sf).groupBy(
        gates.disclaimer(gates.query_type(c), gates.specialties(c)).alias("disclaimer")
    ).agg(F.count("*").alias("n"))


def emergency_level(spark, sf):
    found = _u(spark, sf).withColumn("found", symptoms.emergencies(F.col("text")))
    score = symptoms.severity_score(F.col("found"))
    return found.select(
        *KEY, (F.size("found") > 0).alias("is_emergency"), score.alias("severity_score"),
        symptoms.emergency_level(score).alias("level"))


def emergency_categories(spark, sf):
    found = _u(spark, sf).select(
        *KEY, F.explode(symptoms.emergencies(F.col("text"))).alias("e"))
    return found.select(*KEY, "e.category", "e.term", "e.hits", "e.weight")


def symptom_rules(spark, sf):
    return _u(spark, sf).select(
        *KEY, F.explode(symptoms.rule_entities(X.squeezed(F.col("text")))).alias("e")).select(
        *KEY, "e.label", "e.text", "e.start", "e.stop")


def symptom_entities(spark, sf):
    merged = symptoms.merge_entities(symptoms.rule_entities(X.squeezed(F.col("text"))))
    return _u(spark, sf).select(*KEY, F.posexplode(merged).alias("position", "e")).select(
        *KEY, "position", "e.label", "e.text", "e.start")


def duration_mentions(spark, sf):
    return _u(spark, sf).select(
        *KEY, F.explode(symptoms.durations(X.squeezed(F.col("text")))).alias("d")).select(
        *KEY, "d.pattern", "d.text", "d.start", "d.stop")


def severity_mentions(spark, sf):
    return _u(spark, sf).select(
        *KEY, F.explode(symptoms.severities(X.squeezed(F.col("text")))).alias("s")).select(
        *KEY, "s.severity", "s.text", "s.start")


def symptom_normalize(spark, sf):
    merged = symptoms.merge_entities(symptoms.rule_entities(X.squeezed(F.col("text"))))
    return _u(spark, sf).select(*KEY, F.explode(merged).alias("e")).select(
        *KEY, symptoms.normal_category(F.col("e.text"), F.col("e.category")).alias("category"),
        "e.text").distinct()


def symptom_record(spark, sf):
    return symptoms.extraction(_u(spark, sf)).select(
        *KEY, "entities_count", F.size("durations").alias("duration_count"),
        F.size("severities").alias("severity_count"),
        F.length("cleaned_text").alias("cleaned_length"))


# --- oracle SQL -----------------------------------------------------------

T = Q.trimmed("text")
LOW = "low"


def _scope_sql(tie: bool, image: str, tail: str) -> str:
    def whole(p):
        return f"regexp_full_match(t, {Q.lit('(?i)(?:' + p.replace('{name}', 'assistant') + ')')})"

    def search(p):
        return f"regexp_matches(low, {Q.lit(p)})"

    identity = (search(L.IDENTITY_PATTERN.replace("{name}", "assistant")) + " OR "
                + search(f"(?:{L.IDENTITY_PATTERN_WORD_END})(?:$|{X.NOT_WORD})"))
    rules = [
        (image, "medical", 1.0, "image attached"), ("t = ''", "greeting", 1.0, "empty input"),
        (f"n <= 7 AND {whole(L.HOW_ARE_YOU_PATTERN)}", "greeting", 1.0, "how-are-you"),
        (f"n <= 7 AND {whole(L.GREETING_PATTERN)}", "greeting", 1.0, "greeting"),
        (f"n <= 7 AND {whole(L.THANKS_PATTERN)}", "thanks", 1.0, "thanks"),
        (f"n <= 7 AND {whole(L.FAREWELL_PATTERN)}", "farewell", 1.0, "farewell"),
        (f"n <= 10 AND ({identity})", "identity", 1.0, "identity"),
        (search(X.word_start("|".join(VOCABULARY))), "medical", 1.0, "medical vocabulary"),
    ]
    for reason, pattern in gates.out_of_scope_patterns():
        hit = search(pattern)
        if reason == "trivia":
            # DuckDB has no lookahead: medical histories are taken out first.
            other = (f"regexp_replace(low, {Q.lit(X.word_start(L.HISTORY_PATTERN) + f'(?:{L.HISTORY_MEDICAL_TOPICS})')}, "
                     "' ', 'g')")
            hit = f"({hit} OR regexp_matches({other}, {Q.lit(X.word_start(L.HISTORY_PATTERN))}))"
        rules.append((hit, "out_of_scope", 0.95, f"non-medical pattern: {reason}"))
    cont = search(f"^(?:{L.CONTINUATION_PATTERN})(?:$|{X.NOT_WORD})")
    rules.append((f"turn > 0 AND (n <= 12 OR {cont})", "medical", 0.6,
                  "conversational continuation"))
    if tie:
        rules.append(("n >= 4 AND round(other - medical, 6) > 0.05 AND medical < 0.45",
                      "out_of_scope", 0.7, "embedding margin"))
    def pick(i):
        return "CASE " + " ".join(f"WHEN {r[0]} THEN {Q.lit(r[i])}" for r in rules)
    sims = f", {_anchor_ctes()}" if tie else ""
    source = "u JOIN sims USING (conv_id, turn)" if tie else "u"
    cols = ", medical, other" if tie else ""
    return f"""WITH {U.SQL}{sims},
 p AS (SELECT conv_id, turn, role, {T} AS t, lower({T}) AS low,
   {Q.word_count('text')} AS n{cols} FROM {source}),
 g AS (SELECT conv_id, turn, role, {pick(1)} ELSE 'medical' END AS kind,
   ({pick(2)} ELSE 0.5 END)::DOUBLE AS confidence,
   {pick(3)} ELSE 'default lenient' END AS reason FROM p)
{tail}"""


def _anchor_ctes() -> str:
    anchors = [(f"m{i}", t) for i, t in enumerate(L.MEDICAL_ANCHORS)]
    anchors += [(f"o{i}", t) for i, t in enumerate(L.OTHER_ANCHORS)]
    return f"""ut AS (SELECT conv_id * 1000 + turn AS key, text FROM u),
 anchors AS (SELECT * FROM {Q.rows(anchors)} x(key, text)),
 uv AS ({Q.embedding('ut', 'key')}), av AS ({Q.embedding('anchors', 'key')}),
 sims AS (SELECT uv.key // 1000 AS conv_id, uv.key % 1000 AS turn,
   round(max(CASE WHEN av.key LIKE 'm%' THEN list_dot_product(uv.vec, av.vec) END), 6) AS medical,
   round(max(CASE WHEN av.key LIKE 'o%' THEN list_dot_product(uv.vec, av.vec) END), 6) AS other
   FROM uv, av GROUP BY ALL)"""


SCOPE_SQL = _scope_sql(True, "conv_id % 13 = 0 AND turn = 0",
                       "SELECT conv_id, turn, kind, confidence, reason FROM g")
# Pieces between the occurrences of a term give their places.
MENTION_SQL = f"""WITH v AS (SELECT DISTINCT unnest({Q.tokens('text')}) AS term FROM benchmark),
 w AS (SELECT term FROM v WHERE len(term) >= 5
   AND len(list_filter(range(1, len(term)), lambda k: term[1:k] = substr(term, len(term) - k + 1))) = 0),
 d AS (SELECT doc_id, lower(text) AS low FROM documents),
 h AS (SELECT doc_id, term, string_split(low, term) AS p FROM d JOIN w ON contains(low, term)),
 o AS (SELECT doc_id, term, list_transform(p, lambda x: len(x)) AS n FROM h),
 s AS (SELECT doc_id, term, unnest(range(1, len(n))) AS i, n FROM o),
 g AS (SELECT doc_id, term, (list_sum(n[1:i]) + (i - 1) * len(term))::INT AS start FROM s)
SELECT doc_id, count(*) AS mentions, count(DISTINCT term) AS terms, sum(start)::BIGINT AS places, max(start) AS last FROM g GROUP BY doc_id"""
HEUR_SQL = _scope_sql(False, "false",
                      "SELECT role, kind, reason, count(*) AS n FROM g GROUP BY ALL")
ANCHOR_SQL = f"WITH {U.SQL}, {_anchor_ctes()} SELECT * FROM sims"

TYPE = Q.first_rule("lower(text)", L.QUERY_TYPE_RULES, "'general'")
SYMPTOM_TERMS = [t for _, t in L.flatten(L.SYMPTOM_KEYWORDS)]
TYPE_WITH_SYMPTOMS = Q.first_rule(
    "lower(text)", L.QUERY_TYPE_RULES,
    f"CASE WHEN {Q.contains_any('lower(text)', SYMPTOM_TERMS)} "
    "THEN 'differential_diagnosis' ELSE 'general' END")
LOWT = Q.trimmed("lower(text)")
COMPLEXITY = f"""CASE
 WHEN {Q.word_count('text')} <= 4 AND regexp_matches({LOWT}, {Q.lit(X.whole_words(L.COMPLEXITY_GREETING))}) THEN 'greeting'
 WHEN ({' OR '.join(f'starts_with({LOWT}, {Q.lit(p)})' for p in L.COMPLEXITY_FACT_PREFIXES)}) AND {Q.word_count('text')} < 10 THEN 'simple_fact'
 ELSE {Q.first_rule(LOWT, L.COMPLEXITY_RULES,
  f"CASE WHEN {Q.word_count('text')} > 25 OR len(text) - len(replace(text, '?', '')) > 1 OR {Q.contains_any(LOWT, L.COMPLEXITY_MULTIPART)} THEN 'complex_medical' ELSE 'explanation' END")} END"""
CLASSES_SQL = f"""WITH {U.SQL} SELECT conv_id, turn, {TYPE_WITH_SYMPTOMS} AS query_type,
 {COMPLEXITY} AS complexity,
 {Q.first_rule('lower(text)', L.INTENT_RULES, "'qa'")} AS intent,
 CASE WHEN {COMPLEXITY} = 'greeting' THEN 'none' ELSE 'experts' END AS arm FROM u"""
BASE = "CASE " + " ".join(f"WHEN c = {Q.lit(k)} THEN {v}" for k, v in L.TOKEN_BASE.items()) + " ELSE 120 END"
BUDGET_SQL = f"""WITH {U.SQL}, c AS (SELECT *, {COMPLEXITY} AS c, {Q.word_count('text')} AS n FROM u)
SELECT conv_id, turn, greatest(30, least(500, floor({BASE}
 * (CASE WHEN n < 5 THEN 0.5e0 WHEN n < 10 THEN 0.8e0 WHEN n < 20 THEN 1e0 WHEN n < 40 THEN 1.3e0
   ELSE 1.5e0 END * CASE WHEN len(text) > 500 THEN 1.2e0 ELSE 1e0 END))))::INT AS max_tokens FROM c"""
SPECIALTIES = "list_filter([" + ", ".join(
    f"CASE WHEN {Q.contains_any('lower(text)', terms)} THEN {Q.lit(name)} END"
    for name, terms in L.SPECIALTIES.items()) + "], lambda s: s IS NOT NULL)"
SPECIALTY_SQL = f"""WITH {U.SQL} SELECT conv_id, turn,
 coalesce(array_to_string({SPECIALTIES}, ','), '') AS specialties FROM u"""
LT = f"lower({T})"
PREDICATE_SQL = f"""WITH {U.SQL} SELECT conv_id, turn,
 len({LT}) <= 2 OR regexp_matches({LT}, {Q.lit(L.SMALLTALK_PATTERN)}) OR ({Q.word_count('text')} <= 3
   AND NOT {Q.contains_any(LT, L.SHORT_QUERY_MEDICAL_WORDS)}) AS smalltalk,
 {Q.contains_any(LT, L.IDENTITY_PHRASES + ['what is assistant', 'who is assistant'])} AS identity,
 {Q.contains_any('lower(text)', L.HEALTHCARE_TERMS)} OR
   NOT {Q.contains_any('lower(text)', L.NON_HEALTHCARE_MARKERS)} AS healthcare,
 CASE WHEN {Q.contains_any(LT, L.TONE_PLAYFUL)} OR (contains({LT}, '?') AND contains({LT}, 'up'))
   THEN 'playful' WHEN {Q.contains_any(LT, L.TONE_TIRED)} THEN 'tired'
   WHEN {Q.contains_any(LT, L.TONE_FRIENDLY)} OR (contains({LT}, '!') AND {Q.word_count('text')} <= 4)
   THEN 'friendly' ELSE 'plain' END AS tone,
 {Q.contains_any(LT, L.SOURCE_REQUEST_PHRASES)} AS asks_sources,
 coalesce(array_to_string(list_filter({Q.array(L.DRUG_INTERACTION_FLAGS)},
   lambda f: contains(lower(text), f)), ','), '') AS interaction_flags FROM u"""
D = L.DISCLAIMERS
DISCLAIMER_SQL = f"""WITH {U.SQL}, k AS (SELECT {TYPE} AS kind, {SPECIALTIES} AS s FROM u)
SELECT {Q.lit(L.DISCLAIMER_BASE)} || CASE
 WHEN kind = 'differential_diagnosis' THEN {Q.lit(D['differential_diagnosis'])}
 WHEN kind = 'treatment_planning' THEN {Q.lit(D['treatment_planning'])}
 WHEN kind = 'drug_information' THEN {Q.lit(D['drug_information'])}
 WHEN list_contains(s, 'cardiology') OR list_contains(s, 'neurology') THEN {Q.lit(D['cardio_neuro'])}
 ELSE {Q.lit(D['default'])} END AS disclaimer, count(*) AS n FROM k GROUP BY ALL"""

EMERGENCY_ROWS = [(c, t, L.emergency_weight(t)) for c, t in L.flatten(L.EMERGENCY_KEYWORDS)]
EMERGENCY_CTE = f"""kw AS (SELECT * FROM {Q.rows(EMERGENCY_ROWS)} k(category, term, weight)),
 hit AS (SELECT conv_id, turn, category, term, weight, string_split(lower(text), term) AS pieces
   FROM u JOIN kw ON contains(lower(text), term)),
 occ AS (SELECT conv_id, turn, category, term, weight,
   right(list_reduce(pieces[1:i], lambda a, b: a || term || b), 10) AS window_text
   FROM (SELECT *, unnest(range(1, len(pieces))) AS i FROM hit)),
 ok AS (SELECT conv_id, turn, category, term, weight, count(*) AS hits FROM occ
   WHERE len(list_filter(({Q.words('window_text')})[-3:],
     lambda w: w IN ({', '.join(Q.lit(n) for n in L.NEGATIONS)}))) = 0 GROUP BY ALL)"""
LEVEL_SQL = f"""WITH {U.SQL}, {EMERGENCY_CTE},
 s AS (SELECT conv_id, turn, coalesce(sum(hits * weight), 0)::INT AS severity_score,
   count(ok.term) > 0 AS is_emergency FROM u LEFT JOIN ok USING (conv_id, turn) GROUP BY ALL)
SELECT conv_id, turn, is_emergency, severity_score, CASE WHEN severity_score >= 10 THEN 'CRITICAL'
 WHEN severity_score >= 7 THEN 'HIGH' WHEN severity_score >= 3 THEN 'MODERATE' ELSE 'LOW' END AS level
FROM s"""
ECAT_SQL = f"""WITH {U.SQL}, {EMERGENCY_CTE}
SELECT conv_id, turn, category, term, hits::INT AS hits, weight::INT AS weight FROM ok"""

SYM_ROWS = [(i, c, t) for i, (c, t) in enumerate(L.flatten(L.SYMPTOM_KEYWORDS))]
CLEAN = f"cl AS (SELECT conv_id, turn, {Q.squeezed('text')} AS text FROM u)"
RULE_CTE = f"""kw AS (SELECT * FROM {Q.rows(SYM_ROWS)} k(no, category, term)),
 e AS (SELECT conv_id, turn, no, 'SYMPTOM_' || upper(category) AS label, category, term AS text,
   (instr(lower(cl.text), term) - 1)::INT AS start,
   (instr(lower(cl.text), term) - 1 + len(term))::INT AS stop
   FROM cl JOIN kw ON contains(lower(cl.text), term))"""
RULE_SQL = f"""WITH {U.SQL}, {CLEAN}, {RULE_CTE}
SELECT conv_id, turn, label, text, start, stop FROM e"""
MERGE_CTE = """l AS (SELECT conv_id, turn, list([{'no': no, 'label': label, 'category': category,
   'text': text, 'start': start}] ORDER BY no) AS es FROM e GROUP BY ALL),
 m AS (SELECT conv_id, turn, list_reduce(es, lambda acc, x: CASE WHEN len(list_filter(acc,
   lambda y: abs(y.start - x[1].start) < 5 AND contains(x[1].text, y.text))) > 0 THEN acc
   ELSE list_concat(acc, x) END) AS kept FROM l),
 x AS (SELECT conv_id, turn, unnest(kept) AS k FROM m)"""
ENTITY_SQL = f"""WITH {U.SQL}, {CLEAN}, {RULE_CTE}, {MERGE_CTE}
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY k.start, k.no) - 1)::INT
 AS position, k.label AS label, k.text AS text, k.start AS start FROM x"""
NORM_SQL = f"""WITH {U.SQL}, {CLEAN}, {RULE_CTE}, {MERGE_CTE}
SELECT DISTINCT conv_id, turn, {Q.first_rule('k.text', L.NORMALIZE_RULES, 'k.category')} AS category,
 k.text AS text FROM x"""
DUR_PARTS = " UNION ALL ".join(
    f"""SELECT conv_id, turn, {i} AS pattern,
     regexp_extract_all(text, {Q.lit('(?i)' + p)}) AS found,
     regexp_split_to_array(text, {Q.lit('(?i)' + p)}) AS pieces FROM cl"""
    for i, p in enumerate(L.DURATION_PATTERNS))
DUR_CTE = f"""dp AS ({DUR_PARTS}),
 dd AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM dp),
 dur AS (SELECT conv_id, turn, pattern, found[i] AS text,
   (list_sum(list_transform(pieces[1:i], lambda s: len(s)))
   + coalesce(list_sum(list_transform(found[1:i-1], lambda s: len(s))), 0))::INT AS start FROM dd)"""
DUR_SQL = f"""WITH {U.SQL}, {CLEAN}, {DUR_CTE}
SELECT conv_id, turn, pattern, text, start, (start + len(text))::INT AS stop FROM dur"""
SEV_ROWS = L.flatten(L.SEVERITY_KEYWORDS)
SEV_CTE = f"""sk AS (SELECT * FROM {Q.rows(SEV_ROWS)} k(severity, term)),
 sev AS (SELECT conv_id, turn, severity, term AS text, (instr(lower(cl.text), term) - 1)::INT AS start
   FROM cl JOIN sk ON contains(lower(cl.text), term))"""
SEV_SQL = f"WITH {U.SQL}, {CLEAN}, {SEV_CTE} SELECT * FROM sev"
RECORD_SQL = f"""WITH {U.SQL}, {CLEAN}, {RULE_CTE}, {MERGE_CTE}, {DUR_CTE}, {SEV_CTE}
SELECT cl.conv_id, cl.turn,
 (SELECT count(*) FROM x WHERE x.conv_id = cl.conv_id AND x.turn = cl.turn)::INT AS entities_count,
 (SELECT count(*) FROM dur WHERE dur.conv_id = cl.conv_id AND dur.turn = cl.turn)::INT AS duration_count,
 (SELECT count(*) FROM sev WHERE sev.conv_id = cl.conv_id AND sev.turn = cl.turn)::INT AS severity_count,
 len(text)::INT AS cleaned_length FROM cl"""

REGISTRY = {
    "scope_classify": (scope_classify, SCOPE_SQL),
    "scope_heuristics": (scope_heuristics, HEUR_SQL),
    "vocabulary_mentions": (vocabulary_mentions, MENTION_SQL),
    "anchor_tiebreak": (anchor_tiebreak, ANCHOR_SQL),
    "query_classes": (query_classes, CLASSES_SQL),
    "token_budget": (token_budget, BUDGET_SQL),
    "specialty_tags": (specialty_tags, SPECIALTY_SQL),
    "conversational_predicates": (conversational_predicates, PREDICATE_SQL),
    "disclaimer_choice": (disclaimer_choice, DISCLAIMER_SQL),
    "emergency_level": (emergency_level, LEVEL_SQL),
    "emergency_categories": (emergency_categories, ECAT_SQL),
    "symptom_rules": (symptom_rules, RULE_SQL),
    "symptom_entities": (symptom_entities, ENTITY_SQL),
    "duration_mentions": (duration_mentions, DUR_SQL),
    "severity_mentions": (severity_mentions, SEV_SQL),
    "symptom_normalize": (symptom_normalize, NORM_SQL),
    "symptom_record": (symptom_record, RECORD_SQL),
}
