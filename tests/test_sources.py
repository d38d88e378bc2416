"""Files, sinks and streams in temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from lensmere.operators import corpus
from lensmere.plans import ingest
from lensmere.sources import readers, writers
from lensmere.streaming import streams


def test_qa_directory(spark, tmp_path):
    good = tmp_path / "heart_QA"
    good.mkdir()
    (tmp_path / "other").mkdir()
    (good / "a.xml").write_text(
        "<Document><QAPairs><QAPair pid='1'><Question>What  is <![CDATA[<b>x</b>]]>?</Question>"
        "<Answer>It is y.</Answer></QAPair><QAPair><Question>q</Question></QAPair></QAPairs></Document>")
    (tmp_path / "other" / "b.xml").write_text("<D><QAPair><Question>n</Question><Answer>n</Answer></QAPair></D>")
    got = readers.read_qa_directory(spark, str(tmp_path), "QA", "https://example.org/").collect()
    assert len(got) == 1
    assert got[0].category == "heart_QA" and got[0].file == "a.xml"
    assert got[0].question == "What is x?" and got[0].url == "https://example.org/heart_QA/a.xml"


def test_json_layouts(spark, tmp_path):
    for name, body in {"a": '[{"q": "1"}, 3]', "b": '{"x": {"q": "1"}, "y": 2}',
                       "c": '{"q": "1"}\nbroken\n{"q": "2"}'}.items():
        (tmp_path / f"{name}.json").write_text(body)
    for name, n in {"a": 1, "b": 1, "c": 2}.items():
        path = str(tmp_path / f"{name}.json")
        assert readers.read_json_records(spark, path, "document").count() == n
    assert readers.read_json_records(spark, str(tmp_path / "c.json")).count() == 2


def test_first_present_key_wins_even_if_empty(spark):
    df = spark.createDataFrame([(json.dumps({"question": "", "q": "x", "contexts": ["a", {"text": "b"}, 3]}),)],
                               "record string")
    r = readers.record_fields(df).first()
    assert r.question == "" and r.context == "a b"


def test_concept_file(spark, tmp_path):
    row = ["7", "ENG"] + [""] * 4 + ["Y"] + [""] * 4 + ["RXNORM", "IN", "", "Aspirin", "", "", ""]
    (tmp_path / "c.rrf").write_text("|".join(row) + "\nshort|line\n" + "|".join(["7", "FRE"] + row[2:]) + "\n")
    rows = corpus.concept_rows(readers.read_concepts(spark, str(tmp_path / "c.rrf")))
    got = corpus.concepts(rows).collect()
    assert [(r.id, r.preferred) for r in got] == [("rxnorm_7", "Aspirin")]


def test_chunk_files_skip_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1", "text": "a"}\nnot json\n{"id": "2"}\n')
    assert {r.id for r in readers.read_chunks(spark, str(tmp_path)).collect()} == {"1", "2"}


def test_drug_files(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps([{"name": "A", "content": " x  y "}, {"name": "B", "content": ""}]))
    got = readers.read_drug_files(spark, [str(path), str(tmp_path / "missing.json")]).collect()
    assert [(r.drug_name, r.text, r.source) for r in got] == [("A", "x y", "Drug Database")]


def test_vector_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [1.0, 0.0])], "id string, embedding array<double>")
    writers.write_vector_index(chunks, str(tmp_path / "i"), "hashing")
    opened = writers.open_vector_index(spark, str(tmp_path / "i"), chunks, "hashing")
    assert abs(opened.filter("id = 'a'").first().embedding[0] - 0.6) < 1e-6
    with pytest.raises(ValueError):
        writers.open_vector_index(spark, str(tmp_path / "i"), chunks.limit(1))
    with pytest.raises(ValueError):
        writers.open_vector_index(spark, str(tmp_path / "i"), chunks, "another")


def test_swap_refuses_low_recall_and_existing_backup(spark, tmp_path):
    for name in ("old", "new"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_text(name)
    paths = [str(tmp_path / n) for n in ("old", "new", "kept")]
    with pytest.raises(ValueError):
        writers.swap_index(spark, 0.5, 0.95, *paths)
    writers.swap_index(spark, 0.99, 0.95, *paths)
    assert (tmp_path / "old" / "f").read_text() == "new"
    assert (tmp_path / "kept" / "f").read_text() == "old"
    with pytest.raises(ValueError):
        writers.swap_index(spark, 0.99, 0.95, *paths)


def test_contexts_resume(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    chunks = spark.createDataFrame([("1", "alpha"), ("2", "beta")], "id string, text string")
    chunks.write.parquet(str(source))

    def run(state):
        stream = spark.readStream.schema(chunks.schema).parquet(str(source))
        streams.add_contexts(stream, F.upper, out, str(tmp_path / state)).awaitTermination()
        return spark.read.parquet(out)

    assert run("s").count() == 2
    spark.createDataFrame([("2", "beta"), ("3", "gamma")], chunks.schema).write.mode("append").parquet(str(source))
    got = run("s").collect()
    assert sorted((r.id, r.ctx) for r in got) == [("1", "ALPHA"), ("2", "BETA"), ("3", "GAMMA")]


def test_answer_context(spark, sf):
    got = ingest.answer_context(spark, sf).collect()
    assert len({r.conv_id for r in got}) == len(got)
    for r in got:
        assert (r.prompt is not None) == (r.kind == "medical")
        assert r.passages <= 12
        if r.kind == "medical" and r.complexity != "greeting":
            assert r.passages > 0 and "Specialist perspectives" in r.prompt
