"""Cases in which an operator once did less than its whole job."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
import plain  # noqa: E402
from lensmere.llm import chat, quality, spans  # noqa: E402


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]


# 2. Chat


def test_rewrites_that_only_long_conversations_show(spark):
    """A template that drops turns older than 100 rewrites a conversation of 150, not one of 90 or 100."""
    rows = [(c, i, "assistant" if i % 2 else "user", f"turn {i}") for c, n in ((1, 150), (2, 90), (3, 64), (4, 100)) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def forgets(turns):
        return "".join(f"[{r}]{t}\n" for r, t in turns[-100:])

    got = {}
    for r in chat.formatted(df, forgets).collect():
        got.setdefault(r.conv, []).append(r)
    for c, n in ((1, 150), (2, 90), (3, 64), (4, 100)):
        assert {r.rewrites for r in got[c]} == {n > 100}
        assert "".join(r.formatted for r in got[c]) == forgets([x[2:] for x in rows if x[0] == c])
        assert sum(len(r.turns) for r in got[c]) == (0 if n > 100 else n)


# 7. Substrings


def test_passages_begin_anywhere_in_a_sentence(spark):
    """A passage is found after any number of other words of its sentence, with and without marks at sentence ends."""
    rng = random.Random(3)
    bare = words(rng, 120)
    prose = [w + "." * (i % 23 == 22) for i, w in enumerate(words(rng, 120))]
    rows = []
    for passage in (bare, prose):
        for before in range(24):
            rows.append((len(rows), " ".join(words(rng, before) + passage + words(rng, 40))))
    got = {r.doc_id: r for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for at, passage in ((0, bare), (24, prose)):
        assert got[at].text == rows[at][1] and got[at].removed_words == 0
        for i in range(at + 1, at + 24):
            assert 70 <= got[i].removed_words <= 120, (i, got[i].removed_words)
            left = got[i].text.split()
            assert rows[i][1].split()[:i - at] == left[:i - at] and rows[i][1].split()[-40:] == left[-40:]


def test_one_edit_does_not_hide_the_rest_of_a_sentence(spark):
    rng = random.Random(4)
    line = words(rng, 200)
    rows = [(0, " ".join(line)), (1, " ".join(line[:50] + ["inserted"] + line[50:]))]
    got = {r.doc_id: r for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].removed_words == 0 and got[1].removed_words >= 160 and "inserted" in got[1].text


def test_short_repeats_go_too(spark):
    """Copies of a short text, of three short sentences and of lines without spaces."""
    rows = [(i, "Only five words in here.") for i in range(5)]
    rows += [(10, "One two. Three four. Five six. Own end of ten."), (11, "Begin of eleven. One two. Three four. Five six."),
             (12, "aaaa\nbbbb\ncccc\ndddd"), (13, "first\naaaa\nbbbb\ncccc\ndddd\nlast")]
    got = {r.doc_id: (r.text, r.removed_words) for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(5)] == [(rows[0][1], 0)] + [("", 5)] * 4
    assert got[10] == (rows[5][1], 0) and got[11] == ("Begin of eleven.", 6)
    assert got[12] == (rows[7][1], 0) and got[13] == ("first\nlast", 4)


def test_one_word_again_and_again_is_no_repeat(spark):
    """Equal pairs are cut at the first of them only; no part of a sentence has fewer than five words."""
    rows = [(1, "It is very " + "very " * 30 + "late."), (2, "0 " * 22), (3, " ".join("ab cd".split() * 12)), (4, "one " * 17), (5, "x " * 33)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_hash", "_places", "_key", "_mark", "key", "mark", "row", "k", "m", "places", "hash", "other"):
        df = df.withColumn(c, F.lit("own"))
    got = spans.without_repeats(df).collect()
    assert {(r.doc_id, r.text, r.removed_words) for r in got} == {(k, t, 0) for k, t in rows} and all(r._places == r.k == "own" for r in got)
    rng = random.Random(8)
    for _ in range(200):
        text = " ".join(rng.choices(["a", "b", "c", "a.", "d"] if rng.random() < 0.5 else ["a", "b"], k=rng.randint(1, 90)))
        parts = plain.sentences(text)
        units = spans.Units(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert units.words.tolist() == [len(p) for p in parts]


# 10. Classifier


@pytest.mark.parametrize("most", [300, 1 << 21])
def test_every_gram_counts_whatever_is_held_at_a_time(spark, most):
    """A model of more grams than are held gives each language the perplexities of the whole model."""
    rng = random.Random(5)
    trusted = [(" ".join(words(rng, 60)), "aa") for _ in range(20)] + [("ÄÖ kleine Sprache, wenig Text 你好", "bb"), ("x", None)]
    docs = trusted[:3] + trusted[20:] + [(" ".join(words(rng, 30)), "aa"), ("你好 kleine", "bb"), ("unknown", "cc"), ("", "aa"), (None, "aa")]
    sent = quality.sent_out(spark.createDataFrame(trusted, "text string, lang string"), 5, most)
    assert (len(sent) > 5) == (most == 300)
    rows = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "i long, text string, lang string")
    got = {r.i: r.log_perplexity for r in quality._scored(rows, sent, 5, "text", "lang", ["i"]).collect()}
    score = plain.kneser_ney(trusted)
    for i, (text, lang) in enumerate(docs):
        assert got[i] == (pytest.approx(score(text, lang), rel=1e-5) if text else None)


def test_rare_grams_stay_with_a_small_table(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 40)), "aa") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    by = [{r.doc_id: r.log_perplexity for r in quality.classified(docs, labels, most_grams=m).collect()} for m in (500, 1 << 21)]
    assert by[0] == pytest.approx(by[1], rel=1e-5)


# Pipeline


def test_row_numbers_of_near_dedup_are_written(spark, sf):
    """Rows are numbered once: the jobs that find duplicates and the one that removes them read the same numbers."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = corpus_pipeline.near_dedup_stage(spark, docs, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan
