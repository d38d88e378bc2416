"""Fragments of the oracle SQL shared by several queries (DuckDB dialect)."""

from __future__ import annotations

from lensmere.functions import lexicons as L
from lensmere.functions import text as X
from lensmere.operators import models


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def rows(values) -> str:
    """VALUES list."""
    return "(VALUES " + ", ".join(
        "(" + ", ".join(lit(v) for v in row) + ")" for row in values) + ")"


def tokens(text: str, stopwords=None) -> str:
    stop = L.INDEX_STOPWORDS if stopwords is None else stopwords
    found = f"regexp_extract_all(lower({text}), {lit(X.INDEX_TOKEN)})"
    return f"list_filter({found}, lambda t: t NOT IN ({', '.join(lit(s) for s in stop)}))"


def squeezed(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, {lit(X.WS + '+')}, ' ', 'g'), '^ | $', '', 'g')"


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, {lit('^' + X.WS + '+|' + X.WS + '+$')}, '', 'g')"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, {lit(X.NOT_WS + '+')})"


def word_count(text: str) -> str:
    return f"len({words(text)})"


def contains_any(text: str, terms) -> str:
    return f"(len(list_filter({array(terms)}, lambda t: contains({text}, t))) > 0)"


def first_rule(text: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN {contains_any(text, terms)} THEN {lit(label)}"
                     for label, terms in rules)
    return f"CASE {whens} ELSE {default} END"


def hash32(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def embedding(source: str, id_column: str, text: str = "text",
              dim: int = models.EMBEDDING_DIM) -> str:
    """SELECT of (id, vec) by signed feature hashing, as the default embedder does."""
    return f"""
    SELECT {id_column}, list_transform(v, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS vec
    FROM (SELECT {id_column}, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (
      SELECT d.{id_column}, list(coalesce(s.s, 0)::DOUBLE ORDER BY d.b) AS v
      FROM (SELECT {id_column}, unnest(range({dim})) AS b FROM {source}) d
      LEFT JOIN (
        SELECT {id_column}, {hash32('t')} % {dim} AS b,
          sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END) AS s
        FROM (SELECT {id_column}, unnest({tokens(text)}) AS t FROM {source})
        GROUP BY ALL) s USING ({id_column}, b)
      GROUP BY d.{id_column}))"""


def ranked(source: str, k: int, by="query_id", item="doc_id", score="score") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, {item}) AS rank
    FROM {source} QUALIFY rank <= {k}"""


def bm25(docs: str, queries: str, k: int, prefix: str = "", text: str = "text",
         query_text: str = "text", vocabulary: str = "") -> str:
    """CTEs ending in {prefix}sparse(query_id, doc_id, score, rank)."""
    p = prefix
    keep = f"WHERE term IN (SELECT term FROM {vocabulary})" if vocabulary else ""
    return f"""
    {p}tok AS (SELECT doc_id, unnest({tokens(text)}) AS term FROM {docs}),
    {p}post AS (SELECT doc_id, term, count(*) AS tf FROM {p}tok {keep} GROUP BY ALL),
    {p}len AS (SELECT d.doc_id, coalesce(sum(tf), 0)::DOUBLE AS len
               FROM {docs} d LEFT JOIN {p}post USING (doc_id) GROUP BY ALL),
    {p}st AS (SELECT count(*)::DOUBLE AS n,
              CASE WHEN avg(len) = 0 THEN 1 ELSE avg(len) END AS avgdl FROM {p}len),
    {p}df AS (SELECT term, count(*)::DOUBLE AS df FROM {p}post GROUP BY ALL),
    {p}qt AS (SELECT DISTINCT query_id, unnest({tokens(query_text)}) AS term FROM {queries}),
    {p}bm AS (
      SELECT q.query_id, p.doc_id, round(sum(
        ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0
        / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / avgdl))), 6) AS score
      FROM {p}qt q JOIN {p}post p USING (term) JOIN {p}df USING (term)
      JOIN {p}len USING (doc_id), {p}st
      GROUP BY ALL HAVING score <> 0),
    {p}sparse AS ({ranked(p + 'bm', k)})"""


def dense(queries: str, corpus: str, k: int, name: str = "dense", min_score=None) -> str:
    """CTE {name}(query_id, doc_id, score, rank) over (query_id, vec) and (doc_id, vec)."""
    cut = f"WHERE score >= {min_score}" if min_score is not None else ""
    return f"""
    {name} AS ({ranked(f'''(SELECT * FROM (
      SELECT query_id, doc_id, round(list_dot_product(q.vec, c.vec), 6) AS score
      FROM {queries} q, {corpus} c) {cut})''', k)})"""


def rrf(lists, name: str = "fused") -> str:
    union = " UNION ALL ".join(
        f"SELECT query_id, doc_id, rank, {i} AS list_no FROM {t}" for i, t in enumerate(lists))
    return f"""
    {name}_raw AS (SELECT query_id, doc_id, round(sum(1e0 / (60 + rank)), 9) AS score,
      min(list_no * 1000000 + rank) AS first_seen FROM ({union}) GROUP BY ALL),
    {name} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, first_seen, doc_id) AS rank FROM {name}_raw)"""
