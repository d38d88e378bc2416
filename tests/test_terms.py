"""The automaton against regular expressions on the tables' texts."""

import pytest
import regex
from pyspark.sql import functions as F

from lensmere.functions import lexicons as L
from lensmere.operators import gates, terms
from lensmere.session import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


VOCABULARY = sorted({t for x in (L.SYMPTOM_KEYWORDS, L.SPECIALTIES, L.EMERGENCY_KEYWORDS) for _, t in L.flatten(x)} | {"the", "he", "re", "haha", "ß", "x-ray", "c++"})


@pytest.mark.parametrize("start", [False, True])
def test_offsets_are_those_of_patterns(spark, sf, start):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat("text", F.lit(" Äther ß C++ x-ray; pre-the_re hahaha thé headache")).alias("text"))
    texts = texts.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "the")], "doc_id long, text string"))
    got = sorted(map(tuple, terms.mentions(texts, spark.createDataFrame([(t,) for t in VOCABULARY + ["", "THE"]], "term string"), word_start=start).collect()))
    want = []
    for r in texts.select("doc_id", F.lower("text").alias("t")).collect():
        for term in VOCABULARY:
            before = r"(?<![\p{L}\p{N}_])" if start else ""
            want += [(r.doc_id, term, m.start(), m.end()) for m in regex.finditer(before + regex.escape(term), r.t or "", overlapped=True)]
    assert got == sorted(want) and len(want) > 1000
    column = texts.select("doc_id", F.explode(terms.occurrences(F.lower("text"), VOCABULARY, start)).alias("h")).select("doc_id", "h.*")
    assert sorted((r.doc_id, VOCABULARY[r.no], r.start, r.stop) for r in column.collect()) == sorted(want)


def test_a_vocabulary_in_blocks(spark, tmp_path):
    words = [f"word{i}" for i in range(500)]
    table = spark.createDataFrame([(w,) for w in words], "term string")
    texts = spark.createDataFrame([(i, f"{w} and {w.upper()}s") for i, w in enumerate(words)], "doc_id long, text string")
    one, many = (sorted(map(tuple, terms.mentions(texts, table, chars=c).collect())) for c in (1 << 20, 900))
    assert one == many and len(list(terms.blocks_of(table, 900))) > 3
    assert terms.mentions(texts, table.limit(0)).count() == 0
    table.write.parquet(str(tmp_path / "v"))
    assert terms.vocabulary(spark, str(tmp_path / "v")) == sorted(words)


def test_the_gate_takes_beginnings_of_words(spark):
    df = spark.createDataFrame([("my Diagnosis please",), ("misdiagnosed code review",), ("",), (None,)], "text string")
    got = {r.text: r.reason for r in gates.scope(df, vocabulary=["diagnos"]).collect()}
    assert got["my Diagnosis please"] == "medical vocabulary" and got["misdiagnosed code review"] != "medical vocabulary"
