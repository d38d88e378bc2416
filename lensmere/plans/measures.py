"""Queries on evaluation and the summary tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensmere.functions import text as X
from lensmere.operators import evaluation, evidence, experiment, models, tree
from lensmere.plans import assembly, corpora
from lensmere.plans import sql as Q
from lensmere.plans.retrieval import docs, queries, vectors
from lensmere.session import new_folder
from lensmere.tables import table

EMBED = models.hashing_embedder()
SAMPLE = 150


# --- evaluation -----------------------------------------------------------

def _qa(spark, sf):
    """QA passages with their question; the passage of a question is its gold."""
    c = table(spark, sf, "conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "question",
        F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: "), "answer").alias("text"),
        F.lit("QA_pair").alias("type"))


def eligible_questions(spark, sf):
    return evaluation.eligible_questions(_qa(spark, sf)).select("id", "question")


def _sampled(spark, sf):
    return evaluation.sample(evaluation.eligible_questions(_qa(spark, sf)), "id", SAMPLE)


def question_sample(spark, sf):
    return _sampled(spark, sf).select(
        "id", X.keyword_query(F.col("question")).alias("query"))


def keyword_queries(spark, sf):
    return queries(spark, sf).select(
        "query_id", X.keyword_query(F.col("text")).alias("keywords"))


def _ranks(spark, sf):
    q = question_sample(spark, sf).select(F.col("id").alias("query_id"), F.col("query").alias("text"))
    gold = q.select("query_id", F.col("query_id").alias("doc_id"))
    d = _qa(spark, sf).select(F.col("id").alias("doc_id"), "text")
    return experiment.gold_ranks(q, gold, d, EMBED, models.overlap_reranker)


def gold_ranks(spark, sf):
    return _ranks(spark, sf)


def recall_mrr(spark, sf):
    return evaluation.recall_mrr(_ranks(spark, sf))


def rescue_lost(spark, sf):
    return evaluation.rescue_lost(
        evaluation.paired_hits(_ranks(spark, sf), "hybrid_raw", "dense_raw", 1))


def bootstrap_ci(spark, sf):
    return evaluation.bootstrap(
        evaluation.paired_hits(_ranks(spark, sf), "hybrid_raw", "dense_raw", 1))


def coverage_gap(spark, sf):
    """Bootstrap of subtopic coverage: the first passages against all of them."""
    p = assembly.passages(spark, sf)
    subs = assembly._subtopics(spark, sf)

    def fraction(items, name):
        filled = evidence.fill_budget(items)
        return subs.join(filled, "query_id", "left").select("query_id", F.round(
            evidence.covered(F.col("evidence"), F.col("subtopics")) / F.size("subtopics"), 9)
            .alias(name))

    brief = p.filter("rank <= 4")
    return evaluation.bootstrap(fraction(brief, "hit_a").join(fraction(p, "hit_b"), "query_id"))


def latency_summary(spark, sf):
    return evaluation.latency_summary(table(spark, sf, "events"), "value")


def train_dev_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return evaluation.split_train_dev(d, "doc_id").select("doc_id", "part")


def vector_sample(spark, sf):
    return evaluation.sample(vectors(spark, sf).select("doc_id", "category"), "doc_id", 100, 0)


QA_CTE = """qa AS (SELECT u.conv_id * 1000 + u.turn AS id, u.text AS question,
  'Question: ' || u.text || chr(10) || 'Answer: ' || a.text AS text FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""
ELIGIBLE = f"{QA_CTE}, el AS (SELECT * FROM qa WHERE question <> '' AND {Q.word_count('question')} >= 4)"


def _keywords(text: str) -> str:
    stop = ", ".join(Q.lit(s) for s in X.L.KEYWORD_QUERY_STOPWORDS)
    kept = (f"list_filter(regexp_extract_all(lower({text}), {Q.lit(X.KEYWORD_QUERY_TOKEN)}), "
            f"lambda t: t NOT IN ({stop}) AND len(t) > 2)")
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE {text} END"


ELIGIBLE_SQL = f"WITH {ELIGIBLE} SELECT id, question FROM el"
SAMPLE_CTE = f"""{ELIGIBLE}, sm AS (SELECT id, {_keywords('question')} AS query FROM el
  ORDER BY md5(id || '|13'), id LIMIT {SAMPLE})"""
SAMPLE_SQL = f"WITH {SAMPLE_CTE} SELECT * FROM sm"
KEYWORDS_SQL = f"SELECT item_id AS query_id, {_keywords('text')} AS keywords FROM benchmark"
OVERLAP = f"""CASE WHEN len(list_distinct({Q.tokens('q.text')})) = 0 THEN 0 ELSE
 round(len(list_intersect(list_distinct({Q.tokens('q.text')}), {Q.tokens('d.text')}))
 / len(list_distinct({Q.tokens('q.text')})), 6) END"""
RANKS_CTE = f"""{SAMPLE_CTE}, q AS (SELECT id AS query_id, query AS text FROM sm),
 d AS (SELECT id AS doc_id, text FROM qa),
 dv AS ({Q.embedding('d', 'doc_id')}), qv AS ({Q.embedding('q', 'query_id')}),
 {Q.dense('qv', 'dv', 50)}, {Q.bm25('d', 'q', 50)}, {Q.rrf(['dense', 'sparse'])},
 pool AS (SELECT f.query_id, f.doc_id, f.rank FROM fused f WHERE f.rank <= 50),
 ds AS (SELECT *, max(score) OVER (PARTITION BY query_id) >= 0.86 AS skip FROM dense),
 dr AS (SELECT 'dense_rr' AS condition, p.query_id, p.doc_id, p.rank,
   CASE WHEN skip THEN NULL ELSE {OVERLAP} END AS rr FROM ds p JOIN d USING (doc_id) JOIN q USING (query_id)),
 hr AS (SELECT 'hybrid_rr' AS condition, p.query_id, p.doc_id, p.rank, {OVERLAP} AS rr
   FROM pool p JOIN d USING (doc_id) JOIN q USING (query_id)),
 rr AS (SELECT condition, query_id, doc_id, row_number() OVER (PARTITION BY condition, query_id
   ORDER BY rr DESC NULLS LAST, rank) AS rank FROM (SELECT * FROM dr UNION ALL SELECT * FROM hr)),
 runs AS (SELECT 'dense_raw' AS condition, query_id, doc_id, rank FROM dense UNION ALL
   SELECT 'hybrid_raw', query_id, doc_id, rank FROM pool UNION ALL SELECT * FROM rr),
 ranks AS (SELECT c.condition, sm.id AS query_id, coalesce(r.rank, 0)::INT AS rank
   FROM sm, (SELECT DISTINCT condition FROM runs) c LEFT JOIN runs r ON r.condition = c.condition
   AND r.query_id = sm.id AND r.doc_id = sm.id AND r.rank <= 10)"""
RANKS_SQL = f"WITH {RANKS_CTE} SELECT * FROM ranks"
RECALL_SQL = f"""WITH {RANKS_CTE} SELECT condition, count(*) AS n,
 round(avg((rank BETWEEN 1 AND 1)::INT), 3) AS recall_1, round(avg((rank BETWEEN 1 AND 5)::INT), 3) AS recall_5,
 round(avg((rank BETWEEN 1 AND 10)::INT), 3) AS recall_k,
 round(avg(CASE WHEN rank > 0 THEN 1e0 / rank ELSE 0 END), 3) AS mrr FROM ranks GROUP BY condition"""
PAIRS = """pairs AS (SELECT query_id, max((rank = 1)::INT) FILTER (condition = 'hybrid_raw')::DOUBLE AS hit_a,
  max((rank = 1)::INT) FILTER (condition = 'dense_raw')::DOUBLE AS hit_b FROM ranks GROUP BY query_id)"""
RESCUE_SQL = f"""WITH {RANKS_CTE}, {PAIRS} SELECT count(*) FILTER (hit_a > 0 AND hit_b = 0) AS rescued,
 count(*) FILTER (hit_b > 0 AND hit_a = 0) AS lost FROM pairs"""
BOOT = f"""nb AS (SELECT row_number() OVER (ORDER BY md5(query_id || '|1'), query_id) - 1 AS pos,
   hit_a - hit_b AS diff, count(*) OVER () AS n FROM pairs),
 pk AS (SELECT i, {Q.hash32("i || '|' || pos || '|1'")} % n AS pos FROM nb, range(5000) r(i)),
 mn AS (SELECT i, round(avg(diff), 9) AS m FROM pk JOIN nb USING (pos) GROUP BY i),
 so AS (SELECT list(m ORDER BY m) AS m FROM mn)
SELECT round((SELECT avg(hit_a - hit_b) FROM pairs), 3) AS point, round(m[126], 3) AS low,
 round(m[4876], 3) AS high, m[126] > 0 OR m[4876] < 0 AS significant FROM so"""
BOOT_SQL = f"WITH {RANKS_CTE}, {PAIRS}, {BOOT}"


def _fraction(items: str, name: str) -> str:
    return f"""{name}b AS (SELECT *, coalesce(sum(len(text)) OVER (PARTITION BY query_id ORDER BY rank
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM {items} WHERE text <> ''),
 {name}f AS (SELECT query_id, string_agg(substr(text, 1, 2000 - b), ' ' ORDER BY rank) AS evidence
   FROM {name}b WHERE b < 2000 GROUP BY query_id),
 {name} AS (SELECT s.query_id, round(len(list_filter(subs, lambda syn: len(list_filter(syn,
   lambda s: contains(lower(coalesce(evidence, '')), s))) > 0)) / len(subs), 9) AS v
   FROM st3 s LEFT JOIN {name}f USING (query_id))"""


SUBS = assembly.SUBTOPICS.split(" cv AS (")[0].rstrip().rstrip(",")
GAP_SQL = f"""WITH {assembly.PASSAGES}, {SUBS},
 brief AS (SELECT query_id, rank, text FROM p WHERE rank <= 4),
 {_fraction('brief', 'fa')}, {_fraction('p', 'fb')},
 pairs AS (SELECT fa.query_id, fa.v AS hit_a, fb.v AS hit_b FROM fa JOIN fb USING (query_id)), {BOOT}"""
LATENCY_SQL = """WITH s AS (SELECT list(value ORDER BY value) AS v, count(*) AS n, avg(value) AS mean FROM events)
SELECT round(mean, 2) AS mean, round((v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2, 2) AS median,
 round(v[floor(0.95e0 * (n - 1))::BIGINT + 1], 2) AS p95, round(v[1], 2) AS min, round(v[n], 2) AS max FROM s"""
SPLIT_SQL = """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) AS place,
  count(*) OVER () AS n FROM documents),
 z AS (SELECT *, least(CASE WHEN n > 10000 THEN greatest(500, floor(n * 0.01e0)) ELSE greatest(100, floor(n * 0.02e0)) END,
   greatest(2000, floor(n * 0.05e0))) AS size FROM r)
SELECT doc_id, CASE WHEN place <= size THEN 'dev' ELSE 'train' END AS part FROM z"""
VSAMPLE_SQL = """SELECT vec_id AS doc_id, label AS category FROM embeddings
ORDER BY md5(vec_id || '|0'), vec_id LIMIT 100"""


# --- summary tree ---------------------------------------------------------

def _members(spark, sf):
    return vectors(spark, sf).select("doc_id", "embedding", F.col("category").alias("cluster"))


def _texts(spark, sf):
    question = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" why "), "text"))
    return table(spark, sf, "documents").select("doc_id", question.alias("question"), "text")


def centroid_by_cluster(spark, sf):
    return tree.centroids(_members(spark, sf)).select(
        "cluster", F.posexplode("embedding").alias("dim", "x")).select(
        "cluster", "dim", F.round("x", 6).alias("x"))


def cluster_assign(spark, sf):
    m = _members(spark, sf)
    return tree.assign(m, tree.centroids(m, normalise=False)).select(
        "doc_id", "cluster", "distance")


def cluster_sizes(spark, sf):
    done = table(spark, sf, "embeddings").filter("vec_id < 2").select(
        F.col("label").alias("cluster"))
    return tree.cluster_sizes(_members(spark, sf), done, cap=5)


def cluster_representatives(spark, sf):
    return tree.representatives(_members(spark, sf), _texts(spark, sf))


TOPICS, DOMAINS, ROUNDS = 10, 3, 5


def _nodes(spark, sf):
    return tree.levels(vectors(spark, sf), _texts(spark, sf), EMBED, TOPICS, DOMAINS, new_folder(spark, "tree"), ROUNDS)


def tree_nodes(spark, sf):
    return _nodes(spark, sf)


def tree_overview(spark, sf):
    return tree.overview(queries(spark, sf), tree.embedded_nodes(_nodes(spark, sf), EMBED), EMBED,
                         min_score=0.05).select("query_id", "doc_id", "rank", "score", "text", "category")


def kmeans_sizes(spark, sf):
    """Sizes of the clusters that a fixed start leads to."""
    return tree.lloyd(vectors(spark, sf), TOPICS, new_folder(spark, "tree"), ROUNDS).groupBy("cluster").agg(F.count("*").alias("size"))


def _lloyd(source: str, key: str, k: int, p: str, dim: int) -> str:
    """CTEs ending in {p}m({key}, cluster): rounds of nearest centre and mean over {source}({key}, vec)."""
    near = f"round(list_dot_product(vec, vec) - 2 * list_dot_product(vec, c) + list_dot_product(c, c), 6)"
    out = [f"""{p}c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5({key}::VARCHAR), {key}) - 1 AS cluster, vec AS c
  FROM {source} QUALIFY cluster < {k})"""]
    for i in range(ROUNDS + 1):
        out.append(f"""{p}a{i} AS MATERIALIZED (SELECT {key}, cluster FROM (SELECT s.{key}, cluster, row_number() OVER
  (PARTITION BY s.{key} ORDER BY {near}, cluster) AS n FROM {source} s, {p}c{i}) WHERE n = 1)""")
        if i < ROUNDS:
            out.append(f"""{p}x{i} AS (SELECT cluster, dim, avg(x) AS x FROM (SELECT cluster, unnest(range({dim})) AS dim, unnest(vec) AS x
  FROM {p}a{i} JOIN {source} USING ({key})) GROUP BY ALL),
 {p}c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(w.c, o.c) AS c FROM {p}c{i} o LEFT JOIN
  (SELECT cluster, list(x ORDER BY dim) AS c FROM {p}x{i} GROUP BY cluster) w USING (cluster))""")
    return ",\n ".join([*out, f"{p}m AS (SELECT {key}, cluster FROM {p}a{ROUNDS})"])


FOUND = f"""v0 AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS vec FROM embeddings), {_lloyd('v0', 'doc_id', TOPICS, 't', 64)}"""
KMEANS_SQL = f"WITH {FOUND} SELECT cluster, count(*) AS size FROM tm GROUP BY cluster"
BY_LABEL = "m AS (SELECT vec_id AS doc_id, label AS cluster, embedding::DOUBLE[] AS vec FROM embeddings)"
BY_TOPIC = f"{FOUND}, m AS (SELECT doc_id, cluster, vec FROM tm JOIN v0 USING (doc_id))"
CENTRES = """mx AS (SELECT doc_id, cluster, unnest(range(64)) AS dim, unnest(vec) AS x FROM m),
 mu AS (SELECT cluster, dim, avg(x) AS x FROM mx GROUP BY ALL),
 cr AS (SELECT cluster, list(x ORDER BY dim) AS raw FROM mu GROUP BY cluster),
 ce AS (SELECT cluster, raw, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS c FROM cr)"""
MEMBERS = f"{BY_LABEL}, {CENTRES}"
CENTROID_SQL = f"""WITH {MEMBERS} SELECT cluster, unnest(range(64))::INT AS dim,
 unnest(list_transform(c, lambda x: round(x, 6))) AS x FROM ce"""
ASSIGN_SQL = f"""WITH {MEMBERS}, dd AS (SELECT doc_id, ce.cluster, round(list_dot_product(vec, vec)
  - 2 * list_dot_product(vec, raw) + list_dot_product(raw, raw), 6) AS distance FROM m, ce)
SELECT doc_id, cluster, distance FROM dd QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, cluster) = 1"""
SIZES_SQL = """SELECT label AS cluster, count(*) AS size FROM embeddings WHERE label NOT IN
 (SELECT label FROM embeddings WHERE vec_id < 2) GROUP BY label HAVING count(*) >= 3 ORDER BY size DESC, cluster LIMIT 5"""
REPS_OF = f"""nr AS (SELECT m.cluster, doc_id, row_number() OVER (PARTITION BY m.cluster ORDER BY
   round(list_dot_product(vec, c), 6) DESC, doc_id) AS near FROM m JOIN ce USING (cluster) QUALIFY near <= 16),
 nt AS (SELECT cluster, near, CASE WHEN doc_id % 4 = 0 THEN {Q.trimmed("' why ' || text")}
   ELSE substr(text, 1, 200) END AS t FROM nr JOIN documents USING (doc_id)),
 nu AS (SELECT * FROM nt WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY cluster, substr(lower(t), 1, 80) ORDER BY near) = 1),
 reps AS (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY near) AS place, substr(t, 1, 300) AS text
   FROM nu QUALIFY place <= 8)"""
REPS_SQL = f"WITH {MEMBERS}, {REPS_OF} SELECT * FROM reps"


def _node_ctes(sizes: str, reps: str, kind: str, level: int, name: str) -> str:
    body = f"regexp_extract(s, '(?is)OVERVIEW\\s*:\\s*(.+)', 1)"
    title = Q.trimmed("regexp_extract(s, '(?i)TITLE\\s*:\\s*([^\\n]+)', 1)")
    return f"""{name}g AS (SELECT cluster, list(text ORDER BY place) AS ts FROM {reps} GROUP BY cluster),
 {name}s AS (SELECT cluster, size, 'TITLE: ' || {Q.squeezed('ts[1]')}
   || chr(10) || 'OVERVIEW: ' || array_to_string(ts, ' ') AS s FROM {name}g JOIN {sizes} USING (cluster)),
 {name} AS (SELECT '{kind}_' || cluster AS id, {level} AS level, substr({title}, 1, 80) AS title,
   substr({Q.squeezed(body)}, 1, 1500) AS text, size FROM {name}s)"""


NODES = f"""{BY_TOPIC}, {CENTRES}, {REPS_OF}, s1 AS (SELECT cluster, count(*) AS size FROM m GROUP BY cluster HAVING count(*) >= 3),
 {_node_ctes('s1', 'reps', 'topic', 1, 'n1')}, n1v AS MATERIALIZED ({Q.embedding('n1', 'id')}),
 {_lloyd('n1v', 'id', DOMAINS, 'd', models.EMBEDDING_DIM)},
 s2 AS (SELECT cluster, count(*) AS size FROM dm GROUP BY ALL HAVING count(*) >= 3),
 r2 AS (SELECT cluster, place, substr(text, 1, 300) AS text FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) AS place
   FROM dm) JOIN n1 USING (id) WHERE place <= 8),
 {_node_ctes('s2', 'r2', 'domain', 2, 'n2')},
 nodes AS (SELECT * FROM n1 UNION ALL SELECT * FROM n2 WHERE (SELECT count(*) FROM n1) >= {2 * DOMAINS})"""
NODES_SQL = f"WITH {NODES} SELECT * FROM nodes"
OVERVIEW_SQL = f"""WITH q AS (SELECT item_id AS query_id, text FROM benchmark), {NODES},
 ne AS (SELECT id AS doc_id, title || '. ' || text AS full_text FROM nodes WHERE text <> ''),
 nv AS ({Q.embedding('ne', 'doc_id', 'full_text')}), qv AS ({Q.embedding('q', 'query_id')}),
 {Q.dense('qv', 'nv', 2, min_score=0.05)}
SELECT query_id, doc_id, rank, score, 'Topic overview — ' || title || ': ' || text AS text,
 'raptor_level_' || level AS category FROM dense JOIN nodes ON id = doc_id"""

REGISTRY = {
    "eligible_questions": (eligible_questions, ELIGIBLE_SQL),
    "question_sample": (question_sample, SAMPLE_SQL),
    "keyword_queries": (keyword_queries, KEYWORDS_SQL),
    "gold_ranks": (gold_ranks, RANKS_SQL),
    "recall_mrr": (recall_mrr, RECALL_SQL),
    "rescue_lost": (rescue_lost, RESCUE_SQL),
    "bootstrap_ci": (bootstrap_ci, BOOT_SQL),
    "coverage_gap": (coverage_gap, GAP_SQL),
    "latency_summary": (latency_summary, LATENCY_SQL),
    "train_dev_split": (train_dev_split, SPLIT_SQL),
    "vector_sample": (vector_sample, VSAMPLE_SQL),
    "centroid_by_cluster": (centroid_by_cluster, CENTROID_SQL),
    "cluster_assign": (cluster_assign, ASSIGN_SQL),
    "cluster_sizes": (cluster_sizes, SIZES_SQL),
    "cluster_representatives": (cluster_representatives, REPS_SQL),
    "tree_nodes": (tree_nodes, NODES_SQL),
    "tree_overview": (tree_overview, OVERVIEW_SQL),
    "kmeans_sizes": (kmeans_sizes, KMEANS_SQL),
}
