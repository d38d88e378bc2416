"""Queries on readers, knowledge sentences, index checks and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession, functions as F

from lensmere.functions import text as X
from lensmere.operators import answer, corpus, dense, findings, models
from lensmere.plans import assembly
from lensmere.plans import sql as Q
from lensmere.plans import utterances as U
from lensmere.session import checkpoint_folder
from lensmere.sources import readers, templates, writers
from lensmere.streaming import conversations, streams
from lensmere.tables import spread, table


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def qa_xml_pairs(spark, sf):
    """Documents as XML with one good pair, one without answer and one without tags inside."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("category"), F.concat(F.col("doc_id"), F.lit(".xml")).alias("file"),
        F.concat(
            F.lit("<Document><QAPairs>\n<QAPair pid=\"1\"><Question> What about "), F.col("lang"),
            F.lit("?</Question><Answer>"), _escaped(F.col("text")),
            F.lit("</Answer></QAPair>\n<QAPair><Question>No answer</Question><Answer></Answer></QAPair>"
                  "</QAPairs></Document>")).alias("xml"))
    return readers.parse_qa_xml(d, "qa", "https://example.org/").select(
        "doc_id", "question", "answer", "category", "file", "url")


def _json_documents(spark, sf):
    """One JSON document per message: array, object of objects, or lines."""
    c = table(spark, sf, "conversations")
    one = F.to_json(F.struct(F.concat(F.lit("  "), "text").alias("question"),
                             F.col("role").alias("final_decision"), F.lit("x").alias("context")))
    two = F.to_json(F.struct(F.col("role").alias("q"), F.col("text").alias("a"),
                             F.array(F.col("role"), F.lit("b  c")).alias("contexts")))
    three = F.to_json(F.struct(F.lit("").alias("question"), F.col("role").alias("q"),
                               F.array(F.struct(F.col("role").alias("abstract"))).alias("docs")))
    kind = (F.col("conv_id") + F.col("turn")) % 3
    return c.select("conv_id", "turn", F.when(
        kind == 0, F.concat(F.lit(" ["), one, F.lit(", 5, "), two, F.lit(", "), three, F.lit("]"))).when(
        kind == 1, F.concat(F.lit('{"a": '), one, F.lit(', "b": [1], "c": '), two, F.lit(', "d": '),
                            three, F.lit("}"))).otherwise(
        F.concat(one, F.lit("\n{broken\n\n"), two, F.lit("\n7\n"), three)).alias("json"))


def json_records(spark, sf):
    return readers.parse_json_records(_json_documents(spark, sf)).groupBy("conv_id", "turn").agg(
        F.count("*").alias("records"))


def json_record_fields(spark, sf):
    return readers.record_fields(readers.parse_json_records(_json_documents(spark, sf))).select(
        "conv_id", "turn", "question", "answer", "context")


def concept_lines(spark, sf):
    p = table(spark, sf, "part")
    empty = F.lit("")
    cells = [F.col("p_brand"), F.when(F.col("p_partkey") % 5 == 0, "spa").otherwise("Eng"), empty,
             empty, empty, empty, F.lit("Y"), empty, empty, empty, empty, F.lit("RXNORM"),
             F.col("p_type"), empty, F.concat(F.lit(" "), "p_name", F.lit(" ")), empty, empty]
    line = F.concat_ws("|", *cells, F.when(F.col("p_partkey") % 4 > 0, F.lit("CVF")))
    lines = p.select(F.col("p_partkey").alias("seq"), line.alias("value"))
    return corpus.concept_rows(readers.parse_concept_lines(lines)).select(
        "seq", "rxcui", "lat", "ispref", "sab", "tty", "term")


def chunk_lines(spark, sf):
    d = table(spark, sf, "documents")
    good = F.to_json(F.struct(
        F.concat(F.lit("chunk_"), "doc_id").alias("id"), F.col("text"), F.col("source"),
        F.length("text").cast("int").alias("token_count")))
    line = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("{"), good)).otherwise(good)
    return readers.parse_chunk_lines(d.select(F.col("doc_id").alias("line_no"), line.alias("value"))).select(
        "line_no", "id", "text", "source", "token_count")


def image_decode(spark, sf):
    d = table(spark, sf, "documents")
    code = F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit(""))
    data = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), code)).when(
        F.col("doc_id") % 7 == 1, F.lit("%%%")).otherwise(code)
    decoded = X.data_url_bytes(data)
    return d.select("doc_id", F.octet_length(decoded).alias("bytes"), F.md5(decoded).alias("digest"))


def _drug_records(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_type").alias("category"),
        F.lit("testing").alias("indication"), F.concat("p_size", F.lit(" mg")).alias("dosage"),
        F.col("p_brand").alias("contraindications"), F.lit(None).cast("string").alias("side_effects"))


def drug_sentences(spark, sf):
    return templates.drug_texts(_drug_records(spark, sf)).select("seq", "text")


def knowledge_sentences(spark, sf):
    """Diagnosis, treatment, symptom and interaction sentences from suppliers."""
    s = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name, nation = F.col("s_name"), F.col("n_name")
    key = F.col("s_suppkey").alias("seq")
    diagnosis = templates.diagnosis_texts(s.select(
        key, name.alias("condition"), nation.alias("criteria"), nation.alias("differential"),
        name.alias("treatment")))
    treatment = templates.treatment_texts(s.select(
        key, name.alias("condition"), nation.alias("first_line"), nation.alias("alternative"),
        name.alias("supportive")))
    symptom = templates.symptom_texts(s.select(
        key, name.alias("symptom"), F.array(nation, name).alias("urgent"),
        F.array(nation).alias("common"), name.alias("workup")))
    interaction = templates.interaction_texts(s.select(
        key, name.alias("drug1"), nation.alias("drug2"), F.lit("severe").alias("severity"),
        nation.alias("effect"), name.alias("management")))
    kinds = {"diagnosis": diagnosis, "treatment": treatment, "symptom": symptom,
             "interaction": interaction}
    return corpus.union([df.select("seq", F.lit(k).alias("kind"), "text") for k, df in kinds.items()])


def knowledge_chunks(spark, sf):
    drugs = templates.drug_texts(_drug_records(spark, sf)).select(
        "seq", "text", F.lit("drug table").alias("source"), F.lit("Medications").alias("category"),
        F.lit("medication_info").alias("type"), F.col("name").alias("drug_name"),
        F.col("category").alias("drug_category"))
    conditions = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("seq"), F.concat(F.lit("About "), "s_name").alias("text"),
        F.lit("conditions").alias("source"), F.lit("Conditions").alias("category"),
        F.lit("diagnostic").alias("type"), F.col("s_name").alias("condition_name"))
    return templates.integrated_chunks([drugs, conditions])


def index_integrity(spark, sf):
    return writers.integrity(
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")),
        table(spark, sf, "documents").select(F.col("doc_id").alias("id")))


def reply_frames(spark, sf):
    return streams.dialogue_frames(assembly.reply_texts(spark, sf))


def audit_times(spark, sf):
    """Times of audit rows as ISO text and as seconds since 1970."""
    ts = F.col("ts")
    seconds = (F.unix_date(F.to_date(ts)).cast("bigint") * 86_400 + F.hour(ts) * 3_600
               + F.minute(ts) * 60 + F.second(ts))
    return table(spark, sf, "events").select(
        "event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"),
        seconds.alias("epoch"))


def _findings(spark, sf):
    """Mean value per user and event type as the findings of an image."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.round(F.avg("value") / 40, 4).alias("probability"))
    return e.select(
        F.col("user_id").alias("image_id"),
        F.when(F.col("user_id") % 3 == 0, "skin").otherwise("chest_xray").alias("modality"),
        F.when(F.col("event_type") == "click", "Effusion").otherwise(
            F.concat(F.lit("old_"), "event_type")).alias("label"),
        F.least("probability", F.lit(1.0)).alias("probability"))


def top_findings(spark, sf):
    return findings.top_findings(_findings(spark, sf), 0.6).select(
        "image_id", "place", "label", "probability")


def finding_wording(spark, sf):
    return findings.wording(_findings(spark, sf), 0.6)


def image_modality(spark, sf):
    """Modality by saturation of images whose pixels come from part sizes."""
    p = table(spark, sf, "part")
    pixel = F.struct(F.col("p_size").alias("r"), (F.col("p_size") + F.col("p_partkey") % 9).alias("g"),
                     (F.col("p_size") % 7 + 40).alias("b"))
    pixels = F.array(pixel, F.struct(pixel["b"].alias("r"), pixel["b"].alias("g"), pixel["b"].alias("b")))
    return p.select("p_partkey", F.round(findings.mean_saturation(pixels), 6).alias("saturation"),
                    findings.modality(pixels).alias("modality"))


def result_rows(spark, sf):
    """The columns shown for a passage; question and answer only for QA pairs."""
    d = table(spark, sf, "documents")
    none = F.lit(None).cast("string")
    chunks = d.select(
        F.concat(F.lit("chunk_"), "doc_id").alias("id"), "text", "source", F.col("lang").alias("category"),
        none.alias("url"), F.when(F.col("doc_id") % 4 == 0, "QA_pair").otherwise("note").alias("type"),
        X.token_estimate(F.col("text")).alias("token_count"),
        F.when(F.col("doc_id") % 9 == 0, "42").alias("rxcui"), F.col("lang").alias("question"),
        F.col("source").alias("answer"))
    return dense.result_projection(chunks)


def prompt_split(spark, sf):
    d = table(spark, sf, "documents")
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(
        "text", F.lit(" \nCONVERSATION MEMORY:\n"), "lang")).otherwise(F.col("text"))
    return d.select("doc_id", X.split_prompt(marked, "CONVERSATION MEMORY:").alias("p")).select(
        "doc_id", "p.system", "p.user")


def answer_context(spark, sf):
    """The whole way from the newest message of a conversation to its prompt."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return answer.answer_context(U.utterances(spark, sf), d, models.hashing_embedder())


def retrieve_by_intent(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("category")))
    m = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(
            F.when(F.col("item_id") % 2 == 0, "which dose of drug ").otherwise("why "), "text").alias("text"))
    return answer.retrieve_by_intent(m, d, models.hashing_embedder(), "src2")


# --- streams --------------------------------------------------------------

def _run_folder(spark: SparkSession) -> str:
    """A new folder for one stream run, below the shared checkpoint folder."""
    base = checkpoint_folder(spark)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="lensmere-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def stream_session_counts(spark, sf):
    folder = _run_folder(spark)
    events = _event_stream(spark, sf).select(F.col("user_id").alias("session_id"), "ts")
    streams.count_sessions(events, f"{folder}/out", f"{folder}/state").awaitTermination()
    return streams.session_totals(spark, f"{folder}/out")


def _conversation_events(rows):
    """Messages as events: every seventh conversation is renamed at turn 3, every eleventh deleted now and then."""
    action = (F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 3), "rename")
              .when((F.col("conv_id") % 11 == 0) & (F.col("turn") % 5 == 4), "delete").otherwise("append"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("seq"), action.alias("action"), "role", "text")


def stream_conversations(spark, sf):
    folder = _run_folder(spark)
    schema = table(spark, sf, "conversations").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/conversations.parquet*")
    conversations.keep(_conversation_events(rows), folder, f"{folder}/checkpoint").awaitTermination()
    return conversations.listing(spark, folder)


def stream_audit_log(spark, sf):
    folder = _run_folder(spark)
    records = streams.audit_records(
        _event_stream(spark, sf), F.col("event_type"), F.col("ts"), F.struct("event_id", "value"))
    streams.append_audit(records, f"{folder}/out", f"{folder}/state").awaitTermination()
    written = spark.read.schema("event string, payload string, day date").json(f"{folder}/out")
    return written.groupBy("event", "day").agg(
        F.count("*").alias("n"),
        F.sum(F.get_json_object("payload", "$.event_id").cast("bigint")).alias("id_sum"))


CLEAN_CHARS = r"""[^\p{L}\p{N}_\x09-\x0d\x1c-\x20\x{85}\x{a0}.,;:!?()\-'"]"""


def _clean(text: str) -> str:
    return (f"regexp_replace(regexp_replace({Q.squeezed(text)}, '<[^>]+>', '', 'g'), "
            f"{Q.lit(CLEAN_CHARS)}, '', 'g')")


XML_SQL = f"""SELECT doc_id, {_clean("'What about ' || lang || '?'")} AS question, {_clean('text')} AS answer,
 source AS category, doc_id || '.xml' AS file, 'https://example.org/' || source || '/' || doc_id || '.xml' AS url
FROM documents WHERE {_clean('text')} <> ''"""
RECORDS_SQL = "SELECT conv_id, turn, 3::BIGINT AS records FROM conversations"
FIELDS_SQL = f"""SELECT conv_id, turn, {Q.squeezed('text')} AS question, role AS answer, 'x' AS context FROM conversations
UNION ALL SELECT conv_id, turn, role, {Q.squeezed('text')}, role || ' b c' FROM conversations
UNION ALL SELECT conv_id, turn, '', '', role FROM conversations"""
CONCEPT_SQL = """SELECT p_partkey AS seq, p_brand AS rxcui, 'Eng' AS lat, 'Y' AS ispref, 'RXNORM' AS sab, p_type AS tty,
 trim(p_name) AS term FROM part WHERE p_partkey % 4 > 0 AND p_partkey % 5 > 0"""
CHUNK_SQL = """SELECT doc_id AS line_no, 'chunk_' || doc_id AS id, text, source, len(text)::INT AS token_count FROM documents
WHERE doc_id % 10 <> 3"""
IMAGE_SQL = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 7 <> 1 THEN strlen(text)::INT END AS bytes,
 CASE WHEN doc_id % 2 = 0 OR doc_id % 7 <> 1 THEN md5(text) END AS digest FROM documents"""
DRUG_TEXT = """p_name || ' is a ' || p_type || ' used for testing. Typical dosage: ' || p_size
 || ' mg. Contraindications: ' || p_brand || '. Common side effects: .'"""
DRUG_SQL = f"SELECT p_partkey AS seq, {DRUG_TEXT} AS text FROM part"
SUP = "s AS (SELECT s_suppkey AS seq, s_name AS s, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
KNOW_SQL = f"""WITH {SUP}
SELECT seq, 'diagnosis' AS kind, s || ': Diagnostic criteria - ' || n || ' Differential diagnosis includes: ' || n
 || '. Treatment approach: ' || s AS text FROM s UNION ALL
SELECT seq, 'treatment', 'Treatment for ' || s || ': First-line therapy is ' || n || '. Alternative options include '
 || n || '. Supportive care: ' || s FROM s UNION ALL
SELECT seq, 'symptom', s || ': Urgent considerations include ' || n || ', ' || s || '. Common causes are ' || n
 || '. Initial workup should include: ' || s FROM s UNION ALL
SELECT seq, 'interaction', 'Drug interaction: ' || s || ' and ' || n || ' - Severity: severe. Effect: ' || n
 || '. Management: ' || s FROM s"""
KCHUNK_SQL = f"""WITH a AS (SELECT 0 AS part, p_partkey AS seq, {DRUG_TEXT} AS text, 'drug table' AS source,
  'Medications' AS category, 'medication_info' AS type, p_name AS drug_name, p_type AS drug_category,
  NULL AS condition_name FROM part UNION ALL
  SELECT 1, s_suppkey, 'About ' || s_name, 'conditions', 'Conditions', 'diagnostic', NULL, NULL, s_name FROM supplier)
SELECT 'enhanced_' || lpad((row_number() OVER (ORDER BY part, seq) - 1)::VARCHAR, 6, '0') AS id, text, source, category,
 'N/A' AS url, type, {Q.word_count('text')}::INT AS token_count, drug_name, drug_category, condition_name FROM a"""
INTEGRITY_SQL = """SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors,
 (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vector,
 (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS without_chunk"""
FRAMES_SQL = f"""WITH {assembly.REPLIES}, w AS (SELECT reply_id, text, string_split(text, ' ') AS ws FROM rp)
SELECT reply_id, i::INT AS position, 'token' AS event, CASE WHEN i = 0 THEN ws[1] ELSE ' ' || ws[i + 1] END AS data
FROM (SELECT reply_id, ws, unnest(range(len(ws))) AS i FROM w)
UNION ALL SELECT reply_id, len(ws)::INT, 'done', text FROM w"""
STREAM_SQL = """SELECT user_id AS session_id, count(*) AS queries, max(ts) AS last_seen FROM events GROUP BY user_id"""
# What comes after a conversation's last deletion counts; its title is the last rename, or the first user message after it.
STREAM_CONVERSATION_SQL = f"""WITH ev AS (SELECT conv_id, turn AS seq, role, text, CASE WHEN conv_id % 7 = 0 AND turn = 3 THEN 'rename'
   WHEN conv_id % 11 = 0 AND turn % 5 = 4 THEN 'delete' ELSE 'append' END AS action FROM conversations),
 ld AS (SELECT conv_id, max(seq) FILTER (WHERE action = 'delete') AS d FROM ev GROUP BY conv_id),
 lv AS (SELECT ev.* FROM ev JOIN ld USING (conv_id) WHERE d IS NULL OR seq > d),
 bn AS (SELECT conv_id, min(seq) AS born FROM lv WHERE action = 'append' GROUP BY conv_id),
 lf AS (SELECT lv.*, born FROM lv JOIN bn USING (conv_id) WHERE seq >= born),
 bs AS (SELECT conv_id, coalesce(max(seq) FILTER (WHERE action = 'rename'), min(born) - 1) AS s,
   coalesce(arg_max(coalesce(nullif(substr(text, 1, 80), ''), 'Untitled'), seq) FILTER (WHERE action = 'rename'), 'New chat') AS t,
   count(*) FILTER (WHERE action = 'append') AS message_count, max(seq)::BIGINT AS updated FROM lf GROUP BY conv_id),
 fu AS (SELECT conv_id, arg_min(substr({Q.trimmed('text')}, 1, 60), seq) AS f FROM lf JOIN bs USING (conv_id)
   WHERE action = 'append' AND role = 'user' AND {Q.trimmed('text')} <> '' AND seq > s GROUP BY conv_id)
SELECT conv_id, CASE WHEN t IN ('', 'New chat') THEN coalesce(f, t) ELSE t END AS title, message_count, updated
FROM bs LEFT JOIN fu USING (conv_id)"""
AUDIT_SQL = """SELECT event_type AS event, ts::DATE AS day, count(*) AS n, sum(event_id)::BIGINT AS id_sum
FROM events GROUP BY ALL"""

FIND = """f AS (SELECT user_id AS image_id, CASE WHEN user_id % 3 = 0 THEN 'skin' ELSE 'chest_xray' END AS modality,
  CASE WHEN event_type = 'click' THEN 'Pleural effusion' ELSE 'Old ' || upper(event_type[1]) || event_type[2:] END AS label,
  least(round(avg(value) / 40, 4), 1) AS probability FROM events GROUP BY user_id, event_type),
 r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY probability DESC, label) AS place FROM f),
 t AS (SELECT *, CASE WHEN modality = 'skin' THEN place = 1 ELSE probability >= 0.6 END AS top FROM r)"""
TOP_SQL = f"WITH {FIND} SELECT image_id, place, label, probability FROM t WHERE top"
WORD_SQL = f"""WITH {FIND}, k AS (SELECT image_id, CASE modality WHEN 'skin' THEN 'skin image' ELSE 'chest radiograph' END AS kind,
  bool_or(top) AS any_top, string_agg(label || ' (' || round_even(probability * 100, 0)::INT || '%)', ', ' ORDER BY place) FILTER (top) AS share,
  max(label || ' at ' || round_even(probability * 100, 0)::INT || '%') FILTER (place = 1) AS best,
  string_agg(label || ' ' || printf('%.2f', round_even(probability, 2)), '; ' ORDER BY place) FILTER (top) AS tl,
  string_agg(label || ' ' || printf('%.2f', round_even(probability, 2)), '; ' ORDER BY place) FILTER (place <= 3) AS fl
  FROM t GROUP BY ALL)
SELECT image_id, CASE WHEN any_top THEN 'Leading ' || kind || ' finding(s): ' || share || '. Model screening estimate, not a diagnosis.'
 ELSE 'No findings reached the reporting threshold. Highest estimate: ' || best || '. Screening estimate, not a diagnosis.' END AS summary,
 'Automated ' || kind || ' analysis (model-estimated probabilities, for reasoning only, not a diagnosis): '
 || CASE WHEN any_top THEN tl ELSE fl END || '. Values near or below 0.5 are uncertain.' AS block FROM k"""
MODALITY_SQL = """WITH p AS (SELECT p_partkey, p_size AS r, p_size + p_partkey % 9 AS g, p_size % 7 + 40 AS b FROM part),
 s AS (SELECT p_partkey, round(floor((greatest(r, g, b) - least(r, g, b)) * 255 / greatest(r, g, b)) / 2, 6) AS saturation FROM p)
SELECT p_partkey, saturation, CASE WHEN saturation < 25 THEN 'chest_xray' ELSE 'skin' END AS modality FROM s"""
RESULT_SQL = """SELECT 'chunk_' || doc_id AS chunk_id, text, source, lang AS category, '' AS url,
 CASE WHEN doc_id % 4 = 0 THEN 'QA_pair' ELSE 'note' END AS type, (len(text) // 4)::INT AS token_count,
 CASE WHEN doc_id % 9 = 0 THEN '42' END AS rxcui, CASE WHEN doc_id % 4 = 0 THEN lang END AS question,
 CASE WHEN doc_id % 4 = 0 THEN source END AS answer FROM documents"""
SPLIT_SQL = f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {Q.trimmed('text')} ELSE '' END AS system,
 CASE WHEN doc_id % 2 = 0 THEN 'CONVERSATION MEMORY:' || chr(10) || lang ELSE text END AS "user" FROM documents"""
INTENT_SQL = f"""WITH m AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'which dose of drug '
  ELSE 'why ' END || text AS text FROM benchmark),
 i AS (SELECT query_id, {Q.first_rule('lower(text)', X.L.INTENT_RULES, "'qa'")} AS intent FROM m),
 dv AS ({Q.embedding('documents', 'doc_id')}), qv AS ({Q.embedding('m', 'query_id')}),
 {Q.dense('qv', 'dv', 15, 'pool', 0.2)},
 sp AS (SELECT p.query_id, doc_id, score, row_number() OVER (PARTITION BY p.query_id ORDER BY score DESC, doc_id) AS place
   FROM pool p JOIN documents USING (doc_id) JOIN i ON i.query_id = p.query_id
   WHERE source = 'src2' AND intent = 'medication' QUALIFY place <= 3)
SELECT query_id, doc_id, score, place AS rank, 'category' AS found_by FROM sp UNION ALL
SELECT query_id, doc_id, score, rank, 'all' FROM pool WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM sp)"""

TIME_SQL = """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, floor(epoch(ts))::BIGINT AS epoch FROM events"""

REGISTRY = {
    "audit_times": (audit_times, TIME_SQL),
    "top_findings": (top_findings, TOP_SQL),
    "finding_wording": (finding_wording, WORD_SQL),
    "image_modality": (image_modality, MODALITY_SQL),
    "result_rows": (result_rows, RESULT_SQL),
    "prompt_split": (prompt_split, SPLIT_SQL),
    "answer_context": (answer_context, None),
    "retrieve_by_intent": (retrieve_by_intent, INTENT_SQL),
    "qa_xml_pairs": (qa_xml_pairs, XML_SQL),
    "json_records": (json_records, RECORDS_SQL),
    "json_record_fields": (json_record_fields, FIELDS_SQL),
    "concept_lines": (concept_lines, CONCEPT_SQL),
    "chunk_lines": (chunk_lines, CHUNK_SQL),
    "image_decode": (image_decode, IMAGE_SQL),
    "drug_sentences": (drug_sentences, DRUG_SQL),
    "knowledge_sentences": (knowledge_sentences, KNOW_SQL),
    "knowledge_chunks": (knowledge_chunks, KCHUNK_SQL),
    "index_integrity": (index_integrity, INTEGRITY_SQL),
    "reply_frames": (reply_frames, FRAMES_SQL),
    "stream_session_counts": (stream_session_counts, STREAM_SQL),
    "stream_conversations": (stream_conversations, STREAM_CONVERSATION_SQL),
    "stream_audit_log": (stream_audit_log, AUDIT_SQL),
}
