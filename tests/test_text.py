"""Text, extraction and chunking against plain restatements."""

import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lensmere.functions import lexicons as L
from lensmere.functions import text as X
from lensmere.operators import chunking, evaluation, replies, running, symptoms


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


def naive_chunks(text, budget, overlap):
    words = text.split()
    if not words or len(text) // 4 <= budget:
        return [text] if words else []
    out, cur = [], []
    for w in words:
        if cur and len(" ".join(cur + [w])) // 4 > budget:
            out.append(" ".join(cur))
            cur = (cur[-overlap:] if len(cur) > overlap else cur) + [w]
        else:
            cur = cur + [w]
    return out + [" ".join(cur)]


def test_chunks_equal_a_word_by_word_fold(spark):
    rng = random.Random(5)
    texts = ["", "   ", "one", "x" * 3000, " ".join(["y" * 2000] * 5)]
    for _ in range(40):
        texts.append(" ".join("a" * rng.choice([1, 3, 8, 40, 300]) for _ in range(rng.randrange(400))))
    for budget, overlap in ((250, 50), (220, 40), (30, 25)):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
        got = {}
        for r in chunking.chunk_documents(df, budget, overlap).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r.doc_id, []).append(r.text)
        for i, t in enumerate(texts):
            assert got.get(i, []) == naive_chunks(t, budget, overlap), (i, budget)


def test_chunks_cover_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    chunks = chunking.chunk_documents(docs).groupBy("doc_id").agg(F.count("*").alias("n"))
    assert docs.join(chunks, "doc_id", "left").filter("n is null and trim(text) <> ''").count() == 0


def naive_emergency(text):
    low, total = text.lower(), 0
    for _, term in L.flatten(L.EMERGENCY_KEYWORDS):
        at = low.find(term)
        while at != -1:
            before = low[max(0, at - 10):at].split()[-3:]
            if not any(w in L.NEGATIONS for w in before):
                total += L.emergency_weight(term)
            at = low.find(term, at + len(term))
    return total


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(
    ["no", "not", "denies", "without", "chest pain", "seizure", "stroke", "burns", "burnsburns",
     "crushing chest pain", "is fine", "and", "swelling", "x"]), max_size=14))
def test_emergency_score_matches_a_scan(spark, parts):
    text = " ".join(parts)
    got = one(spark, text, lambda c: symptoms.severity_score(symptoms.emergencies(c)))
    assert got == naive_emergency(text)


def test_entities_merge_in_order(spark):
    text = "Headache with chest pain and soreness for 3 days, yesterday very bad"
    kept = one(spark, text, lambda c: symptoms.merge_entities(symptoms.rule_entities(c)))
    assert [(e.text, e.start) for e in kept] == [("headache", 0), ("ache", 4), ("chest pain", 14),
                                                 ("pain", 20), ("sore", 29)] or \
        [e.start for e in kept] == sorted(e.start for e in kept)
    found = one(spark, text, symptoms.durations)
    assert {(d.text, d.start) for d in found} >= {("3 days", 42), ("for 3 days", 38), ("yesterday", 50)}
    for d in found:
        assert text[d.start:d.stop] == d.text


def test_snippets_and_closers(spark):
    text = "First sentence is here. " * 30
    cut = one(spark, text, lambda c: X.snippet(c, 100))
    assert cut.endswith(".") and len(cut) <= 100
    assert one(spark, "short", X.snippet) == "short"
    reply = "One two three four five six seven eight nine. Feel free to ask."
    assert one(spark, reply, X.strip_filler_closer).endswith("nine.")
    assert one(spark, "Too short. Feel free to ask.", X.strip_filler_closer) == "Too short. Feel free to ask."


def test_cleanup(spark):
    assert one(spark, '{"answer": "Fine!!"}', X.light_cleanup) == "Fine."
    assert one(spark, "Answer:  yes\n\n\n\nmore", X.light_cleanup) == "yes\n\nmore"
    assert one(spark, "**a** *b* ```c``` d", X.heavy_cleanup) == "a b d"
    assert one(spark, "go now go now go now go now done", X.heavy_cleanup).count("go now") == 1
    assert one(spark, "a <b>bold</b>  €5", X.clean_markup) == "a bold 5"


def test_labels(spark):
    out = "SPECIFIC: the dose is four grams a day\nBROAD: painkillers for adults in general"
    assert one(spark, out, X.hypothetical_specific) == "the dose is four grams a day"
    assert one(spark, out, X.hypothetical_broad) == "painkillers for adults in general"
    assert one(spark, "<think>x</think> ok\nthen", X.generated_context) == "ok then"
    assert one(spark, "TITLE: A\nOVERVIEW: b\n c", X.summary_body) == "b c"


def test_echo(spark):
    rows = [("Drink a lot of water.\n\nThen rest.", "Drink a lot of water."),
            ("Drink a lot of warer.\n\nThen rest.", "Drink a lot of water. More."),
            ("Something else.\n\nThen rest.", "Drink a lot of water."), ("Only one.", "Only one.")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(replies.strip_opening_echo("a", "b")).collect()]
    assert got == ["Then rest.", "Then rest.", rows[2][0], "Only one."]


def test_sections(spark):
    text = ("Opening\nmore\nRecommendations:\nrest\nPatient should sleep\nand eat\n"
            "Diagnosis\nflu likely\nWarning: fever")
    df = spark.createDataFrame([(1, text), (2, ""), (3, "plain")], "reply_id int, text string")
    got = {r.reply_id: r for r in replies.sections(df).collect()}
    # Text gathered before an assessment heading is the assessment until a later one.
    assert got[1].assessment == "Patient should sleep and eat"
    assert got[1].recommendations == "rest" and got[1].warnings == "Warning: fever"
    assert got[2].assessment == "" and got[3].assessment == "plain"


def test_running_count_with_a_hot_key(spark):
    rows = [(0 if i % 3 else i, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, t int").repartition(7)
    got = running.running_count(df, ["k"], ["t"], F.floor(F.col("t") / 50)).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r.t):
        seen[r.k] = seen.get(r.k, 0) + 1
        assert r.running == seen[r.k]


def test_last_before_crosses_blocks(spark):
    rows = [(1, t, "v%d" % t if t in (3, 40) else None) for t in range(100)]
    df = spark.createDataFrame(rows, "k int, t int, v string")
    got = running.last_before(df, ["k"], ["t"], F.floor(F.col("t") / 10), F.col("v"), "prev")
    for r in got.collect():
        assert r.prev == (None if r.t <= 3 else "v3" if r.t <= 40 else "v40")


def test_order_statistics_are_exact(spark):
    rng = random.Random(2)
    values = sorted(rng.choice([rng.gauss(0, 1), 1.5, 1.5]) for _ in range(997))
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(6)
    got = {r.name: r.value for r in running.order_statistics(df, "x", {
        "p0": lambda n: F.lit(0), "p95": lambda n: F.floor(F.lit(.95) * (n - 1)),
        "last": lambda n: n - 1}, buckets=16).collect()}
    assert got == {"p0": values[0], "p95": values[int(.95 * 996)], "last": values[-1]}


def test_split_sizes(spark):
    parts = {r.part: r["count"] for r in evaluation.split_train_dev(
        spark.range(12_000), "id").groupBy("part").count().collect()}
    assert parts == {"dev": 500, "train": 11_500}
