"""Graphs of passages on small cases."""

import hashlib

import pytest

from lensmere.operators import graph
from lensmere.session import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def key(kind, label):
    return f"{kind}_{hashlib.md5(label.lower().encode()).hexdigest()[:12]}"


def test_a_corpus_merges_its_passages(spark):
    rows = [("Fever and headache. Viral Infection is seen. Ibuprofen helps", "Medications"), ("fever with Viral Infection", "other"),
            ("Viral infection, viral Viral INFECTION", "x"), (None, "medications"), ("", None), ("Aspirin Ibuprofen", "MEDICATIONS")]
    df = spark.createDataFrame(rows, "text string, category string")
    nodes = {r.id: (r.type, r.label, r.passages) for r in graph.nodes(df).collect()}
    assert nodes[key("symptom", "fever")] == ("symptom", "fever", 2)
    assert nodes[key("treatment", "Aspirin Ibuprofen")][2] == 1
    assert not any(t == "treatment" and "Viral" in label and n > 1 for t, label, n in nodes.values())
    edges = {(r.source, r.target): (r.label, r.weight) for r in graph.edges(df).collect()}
    heads = {r.id: r.label for r in graph.nodes(df).collect()}
    for (a, b), (label, weight) in edges.items():
        assert (a.split("_")[0], label, b.split("_")[0]) in (("symptom", "suggests", "condition"), ("condition", "managed_by", "treatment"))
        assert weight >= 1 and a in heads and b in heads
    nearest = graph.around(graph.edges(df), spark.createDataFrame([(key("symptom", "fever"),)], "id string"), 2).collect()
    assert nearest and [r.place for r in nearest] == list(range(1, len(nearest) + 1))


def test_treatments_come_from_medication_passages_only(spark):
    q = spark.createDataFrame([(1, "likely migraine"), (2, None)], "query_id int, text string")
    p = spark.createDataFrame([(1, 1, "Take Paracetamol Daily", "medications"), (1, 2, "Avoid Sugar", "diet")], "query_id int, rank int, text string, category string")
    got = {r.query_id: {n.label: n.type for n in r.nodes} for r in graph.of_queries(q, p).collect()}
    assert got[2] == {} and got[1]["Migraine"] == "condition"
    assert {k for k, t in got[1].items() if t == "treatment"} == {"Take Paracetamol", "Daily"}
