"""A tenth of the documents, drawn towards the benchmark's distribution of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lensmere.llm import resampling
from lensmere.tables import table


def resample(spark: SparkSession, sf: str) -> DataFrame:
    docs, target = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("text")
    return resampling.scored(docs, target)


# DuckDB has no crc32: the checksum of every distinct word is folded over its bytes, eight steps a byte.
SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
o AS (SELECT doc_id, unnest(a) AS w FROM d),
own AS (SELECT w, count(*) AS n FROM o GROUP BY w),
tgt AS (SELECT w, count(*) AS n FROM b GROUP BY w),
words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM own UNION SELECT w FROM tgt)),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(x, 2 * i + 1, 2))::BIGINT FOR i IN range(len(x) // 2)]),
    lambda c, y: list_reduce(list_prepend(xor(c, y), [0::BIGINT FOR k IN range(8)]),
      lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 10000 AS k FROM words),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM own)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM tgt)::DOUBLE AS t),
ks AS (SELECT k, sum(n) AS n FROM own JOIN crc USING (w) GROUP BY k),
kt AS (SELECT k, sum(n) AS n FROM tgt JOIN crc USING (w) GROUP BY k),
gain AS (SELECT ks.k, floor(1000 * ln((coalesce(kt.n, 0)::DOUBLE + 1) * (s + 10000) / ((ks.n::DOUBLE + 1) * (t + 10000))))::BIGINT AS g
  FROM ks LEFT JOIN kt USING (k), sums),
sc AS (SELECT doc_id, sum(g)::BIGINT AS g, count(*) AS n FROM o JOIN crc USING (w) JOIN gain USING (k) GROUP BY doc_id),
w AS (SELECT d.doc_id, len(a) AS n_features, coalesce(floor(sc.g::DOUBLE / sc.n), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN sc USING (doc_id)),
s AS (SELECT doc_id, n_features::BIGINT AS n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS p FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= (SELECT 10 * count(*) // 100 FROM s WHERE n_features >= 20) THEN p END AS rank FROM r"""

REGISTRY = {"op11_importance_resampling": (resample, SQL)}
