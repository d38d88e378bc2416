"""Registered queries against SQL or plain Python, and the pipeline stage by stage."""

import hashlib
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
import oracle  # noqa: E402
import plain  # noqa: E402
from lensmere.llm import html_main, mixing, pieces, token_edits  # noqa: E402
from lensmere.llm.plans import registry  # noqa: E402
from lensmere.llm.token_edits_query import own_edits  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WITH_SQL = sorted(n for n, (_, sql) in registry().items() if sql)


@pytest.mark.parametrize("name", WITH_SQL)
def test_against_sql(spark, sf, name):
    run, sql = registry()[name]
    n, _, problem, *_ = oracle.compare(spark, oracle.connect(sf), sf, run, sql)
    assert problem is None and n > 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry()) == list(range(1, 14))
    assert WITH_SQL == ["op11_importance_resampling", "op12_suffix_array_dedup", "op13_hard_negatives", "op1_minhash_near_dedup", "op2_chat_formatting", "op4_pq_near_dedup", "op9_exact_top_k"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_mixing_query(spark, sf, docs):
    got = registry()["op3_source_mixing"][0](spark, sf).toPandas().merge(docs.select("doc_id", "source", "text").toPandas(), on="doc_id")
    assert len(got) == docs.count() and (got["size"] == got.text.map(lambda t: len(plain.WORD.findall(t)))).all()
    by = got.groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    by = by.loc[sorted(by.index)]
    assert (by["size"] == by.own).all() and by.target.tolist() == mixing.targets(list(zip(by.index, by["size"].tolist())))
    assert ((by.taken - by.target).abs() <= by.most).all() and (got.taken <= 3 * got["size"]).all()


def test_token_count_query(spark, sf, docs):
    got = {r.doc_id: r for r in registry()["op5_token_counts"][0](spark, sf).collect()}
    full = token_edits.Counter(token_edits.default_ranks()).encoding.encode_ordinary
    for r in docs.withColumn("edits", own_edits()).collect():
        t = r.text
        for e in r.edits:
            t = t[:e["start"]] + e["new"] + t[e["stop"]:]
        own = got[r.doc_id]
        assert (own.n_tokens, own.n_tokens_edited, own.n_chars_edited) == (len(full(r.text)), len(full(t)), len(t))


def test_encoding_query(spark, sf, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in registry()["op6_sentencepiece"][0](spark, sf).collect()}
    for r in docs.collect():
        ids = library.encode(r.text)
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_substring_query(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.text, r.removed_words) for r in registry()["op7_substring_dedup"][0](spark, sf).collect()}
    assert got == {k: w for (k, _), w in zip(rows, plain.without_repeats(rows))}


def test_html_query(spark, sf):
    """The pages table holds one article a page, whose blocks are headings and paragraphs."""
    import html
    import re

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = registry()["op8_html_main_text"][0](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
        assert r.text == html_main.main_text(pages[r.page_id].html)


def test_quality_query(spark, sf, docs):
    got = registry()["op10_quality_classifier"][0](spark, sf).toPandas()
    assert len(got) == docs.count() and got.log_perplexity.notna().all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").toPandas().merge(got, on="doc_id")
    assert labels[labels.quality == 1].kept.mean() >= 0.95


def test_pipeline(spark, sf, docs):
    """Each stage on what the one before kept, against plain Python."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "substring_dedup", "mixing", "sentencepiece"]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality"](spark, docs, sf).cache()
    verdicts = {r.doc_id: r.kept for r in registry()["op10_quality_classifier"][0](spark, sf).collect()}
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == {k for k, v in verdicts.items() if v}

    rows = kept.toPandas()
    single = stages["near_dedup"](spark, kept, sf).cache()
    want = plain.near_duplicates(dict(zip(rows.doc_id, rows.text)), 5, 80)
    assert single.columns == COLUMNS and sorted(r.doc_id for r in single.collect()) == sorted({c for _, c in want.values()})

    before = [(r.doc_id, r.text, r.n_chars) for r in single.collect()]
    cut = stages["substring_dedup"](spark, single, sf).cache()
    wanted = plain.without_repeats([r[:2] for r in before])
    assert {(r.doc_id, r.text, r.n_chars) for r in cut.collect()} == {
        (k, t, len(t) if gone else n) for (k, _, n), (t, gone) in zip(before, wanted)}

    mix = stages["mixing"](spark, cut, sf).cache()
    sizes = {r.doc_id: (r.source, len(plain.WORD.findall(r.text))) for r in cut.collect()}
    totals, taken = {}, {}
    for source, n in sizes.values():
        totals[source] = totals.get(source, 0) + n
    for r in mix.collect():
        taken[r.source] = taken.get(r.source, 0) + sizes[r.doc_id][1]
    order = sorted(totals)
    for s, target in zip(order, mixing.targets([(s, totals[s]) for s in order])):
        assert abs(taken.get(s, 0) - target) <= max(n for own, n in sizes.values() if own == s)
    assert mix.columns == COLUMNS and mix.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    out = stages["sentencepiece"](spark, mix, sf).collect()
    texts = {r.doc_id: r.text for r in mix.collect()}
    assert len(out) == mix.count()
    for r in out:
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.text == library.decode(r.ids)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.n_tokens) for r in whole.collect()) == sorted((r.doc_id, r.n_tokens) for r in out)


def test_pipeline_odd_rows(spark, sf):
    """Nulls, empty texts and repeated rows pass through every stage; of repeated rows one stays."""
    text = "Some words that stand here for a text of the table, once and again."
    rows = [(1, text, "en", "a", 10), (1, text, "en", "a", 10), (None, text + " More of it.", None, None, None), (2, None, "en", "b", 0), (3, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    assert stages["near_dedup"](spark, docs, sf).count() == 4
    assert stages["substring_dedup"](spark, docs, sf).count() == 5
    for stage in stages.values():
        docs = stage(spark, docs, sf)
        assert stage is stages["sentencepiece"] or docs.columns == COLUMNS
        docs.collect()
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in stages.values():
        assert stage(spark, empty, sf).count() == 0
