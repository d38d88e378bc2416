"""The stored index against brute force, and its upkeep against a build from scratch."""

import math
import random
from collections import Counter

import pytest

from lensmere.operators import inverted
from lensmere.session import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def corpus(rng, n, first=0, words=60):
    vocabulary = [f"w{i}" for i in range(words)]
    return [(first + i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 25))) + " w0 w0" * (i % 3 == 0)) for i in range(n)]


def by_hand(rows, queries, k):
    toks = [t.split() for _, t in rows]
    total = sum(map(len, toks))
    avg = total / len(rows) if total else 1.0
    df = Counter(w for t in toks for w in set(t))
    out = []
    for q, text in queries:
        found = []
        for (key, _), words in zip(rows, toks):
            c = Counter(words)
            s = sum(math.log(1 + (len(rows) - df[t] + .5) / (df[t] + .5)) * c[t] * 2.5 / (c[t] + 1.5 * (.25 + .75 * len(words) / avg))
                    for t in set(text.split()) if t in c)
            if s:
                found.append((-round(s, 6), key))
        out += [(q, key, -s, i + 1) for i, (s, key) in enumerate(sorted(found)[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def got(df):
    return sorted((r.query_id, -1 if r.doc_id is None else r.doc_id, r.score, r["rank"]) for r in df.collect())


QUERIES = [(1, "w0 w1 w2"), (2, "w3 w3 w59 none"), (3, "absent words"), (4, ""), (5, " ".join(f"w{i}" for i in range(0, 60, 7)))]


@pytest.mark.parametrize("first", [1, 2, 1000])
def test_search_is_that_of_a_scan(spark, tmp_path, first):
    """Many small blocks, repeated rows and ids, ties: the floor never costs a hit."""
    rng = random.Random(first)
    rows = corpus(rng, 300)
    rows += rows[:20] + [(5, "w1 w2 w0"), (5, "w59"), (7, None)]
    inverted.build(frame(spark, rows), str(tmp_path), buckets=8, block_docs=16)
    plain = [(k, t or "") for k, t in rows]
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    for k in (1, 7):
        have, want = got(inverted.search(queries, str(tmp_path), k, first)), by_hand(plain, QUERIES, k)
        assert [(q, d, n) for q, d, _, n in have] == [(q, d, n) for q, d, _, n in want]
        assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(have, want))


def test_only_the_terms_buckets_are_read(spark, tmp_path):
    inverted.build(frame(spark, corpus(random.Random(1), 200)), str(tmp_path), buckets=32, block_docs=16)
    queries = spark.createDataFrame([(1, "w5")], "query_id long, text string")
    df, buckets = inverted.opened(queries, str(tmp_path), 3)
    assert len(buckets) == 1
    read = {p.split("bucket=")[1].split("/")[0] for p in df.inputFiles()}
    assert read == {str(buckets[0])}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert all("bucket" in line for line in plan.split("\n") if "Relation" in line)  # the texts are not read


def test_upkeep_gives_the_index_of_a_full_build(spark, tmp_path):
    """Rows come, change, go, are repeated; each time the result is that of a new index, and only touched buckets are written."""
    rng = random.Random(2)
    rows = corpus(rng, 120)
    folder = str(tmp_path / "kept")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    inverted.build(frame(spark, rows), folder, buckets=16, block_docs=16)
    steps = [
        rows + corpus(rng, 30, 500),
        [(k, "w1 changed text" if k == 3 else t) for k, t in rows[10:]],
        rows[10:] + rows[10:15] + [(None, "w2 w3")],
        [(9000, "w2")],
    ]
    for step in steps:
        docs = frame(spark, step)
        assert not inverted.is_current(docs, folder)
        done = inverted.refresh(docs, folder)
        assert done["rows"] > 0 and inverted.is_current(docs, folder) and inverted.refresh(docs, folder) == {"rows": 0, "buckets": 0}
        have, want = got(inverted.search(queries, folder, 6)), by_hand([(k if k is not None else -1, t) for k, t in step], QUERIES, 6)
        assert [(q, d, n) for q, d, _, n in have] == [(q, d, n) for q, d, _, n in want]
        now = inverted.state(spark, folder)
        assert (now["n_docs"], now["total_len"]) == (len(step), sum(len(t.split()) for _, t in step))


def test_untouched_buckets_stay(spark, tmp_path):
    rng = random.Random(3)
    rows = corpus(rng, 100)
    inverted.build(frame(spark, rows), str(tmp_path), buckets=64, block_docs=16)
    done = inverted.refresh(frame(spark, rows + [(999, "w0 unheard")]), str(tmp_path))
    assert done["rows"] == 1 and 1 <= done["buckets"] <= 2
    manifest = {r.bucket: r.generation for r in spark.read.parquet(f"{tmp_path}/manifest/version=2").collect()}
    assert sum(g == 2 for g in manifest.values()) == done["buckets"] and sum(g == 1 for g in manifest.values()) > 20
    # A version without its last file does not count: the one before is still read.
    import shutil
    shutil.copytree(tmp_path / "state" / "version=2", tmp_path / "state" / "version=3")
    (tmp_path / "state" / "version=3" / "_SUCCESS").unlink()
    assert inverted.state(spark, str(tmp_path))["version"] == 2


def test_an_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    inverted.build(docs, str(tmp_path))
    assert inverted.search(queries, str(tmp_path), 3).count() == 0 and inverted.is_current(docs, str(tmp_path))
    inverted.refresh(spark.createDataFrame([(1, "w0"), (2, "")], "doc_id long, text string"), str(tmp_path))
    assert got(inverted.search(queries, str(tmp_path), 3))[0][:2] == (1, 1)


def test_postings_are_put_together_before_they_move(spark, tmp_path):
    """One row leaves a task for a term and block, however many documents it stands for; a search explodes no entries."""
    rows = [(i, "w0 w0 w1") for i in range(40)] + [(None, "w0"), (None, "w0"), (3, "w0 w0 w1")]
    docs = inverted._tokens(inverted._by_block(inverted._keyed(frame(spark, rows)), 2), None)
    made = docs.mapInArrow(inverted._blocked, inverted._row_schema("bigint")).collect()
    assert len({(r.term, r.block) for r in made}) == len(made) <= 4
    assert sum(r.n for r in made if r.term == "w0") == 43 and sum(r.n for r in made if r.term == "w1") == 41
    assert sum(len(r.entries) for r in made if r.term == "w0") == 41
    inverted.build(frame(spark, rows), str(tmp_path), block_docs=16)
    plan = inverted.search(spark.createDataFrame(QUERIES, "query_id long, text string"), str(tmp_path), 3)._jdf.queryExecution().toString()
    assert "explode(entries" not in plan
    # A row without an id goes like any other.
    assert inverted.refresh(frame(spark, rows[:40]), str(tmp_path))["rows"] == 2
    query = spark.createDataFrame([(1, "w0")], "query_id long, text string")
    assert sorted(r.doc_id for r in inverted.search(query, str(tmp_path), 50).collect()) == list(range(40))
