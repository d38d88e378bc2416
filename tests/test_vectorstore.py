"""Stored vectors follow their texts."""

import pytest
from pyspark.sql import functions as F

from lensmere.operators import models, vectorstore
from lensmere.session import ship

EMBED = models.hashing_embedder()


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def want(df):
    return sorted((r.id, tuple(r.v)) for r in df.select("id", EMBED(F.col("text")).cast("array<float>").alias("v")).distinct().collect())


def have(spark, folder):
    return sorted((r.doc_id, tuple(r.embedding)) for r in vectorstore.vectors(spark, folder, "m").collect())


def test_only_changed_texts_are_embedded(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(i, f"text number {i} of many words") for i in range(200)]

    def frame(rows):
        return spark.createDataFrame(rows, "id long, text string")

    assert vectorstore.refresh(frame(rows), folder, EMBED, "m", 16) == {"embedded": 200, "buckets": 16}
    assert have(spark, folder) == want(frame(rows))
    assert vectorstore.refresh(frame(rows), folder, EMBED, "m") == {"embedded": 0, "buckets": 0}
    rows = [(i, t + (" in context" if i == 7 else "")) for i, t in rows if i != 9] + [(500, "new"), (500, "new")]
    done = vectorstore.refresh(frame(rows), folder, EMBED, "m")
    assert done["embedded"] == 2 and done["buckets"] <= 3
    assert have(spark, folder) == want(frame(rows))
    manifest = {r.bucket: r.generation for r in spark.read.parquet(f"{folder}/manifest/version=2").collect()}
    assert sum(g == 2 for g in manifest.values()) <= 3 and len(manifest) == 16
    with pytest.raises(ValueError):
        vectorstore.vectors(spark, folder, "other")
    assert vectorstore.refresh(frame(rows[:5]), folder, EMBED, "m")["embedded"] == 0
    assert have(spark, folder) == want(frame(rows[:5]))
    assert vectorstore.refresh(frame([]), folder, EMBED, "m")["embedded"] == 0 and have(spark, folder) == []


def test_context_and_body(spark):
    rows = [("ctx", "body"), ("", "body"), (None, "body"), ("ctx", None), ("ctx", ""), (" | ", "b |")]
    got = spark.createDataFrame(rows, "c string, t string").select(vectorstore.with_context(F.col("c"), F.col("t")).alias("x"))
    assert [r.x for r in got.collect()] == ["ctx | body", "body", "body", "ctx", "ctx", "b"]
