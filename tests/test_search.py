"""Search operators against brute force, and their alternative paths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql.functions import lit

from lensmere.operators import dense, fusion, lexical, models, tree


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    # Word 0 is in a third of all documents many times over.
    texts = []
    for i in range(300):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 30))]
        texts.append((i, " ".join(body + ["w0"] * (5 if i % 3 == 0 else 0))))
    queries = [(q, " ".join(rng.sample(words, 4) + ["w0"])) for q in range(12)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    return docs, spark.createDataFrame(queries, "query_id bigint, text string"), texts, queries


def brute_bm25(texts, queries, k):
    toks = {i: t.split() for i, t in texts}
    avg = sum(map(len, toks.values())) / len(toks)
    out = {}
    for q, text in queries:
        scores = []
        for i, words in toks.items():
            s = 0.0
            for t in set(text.split()):
                df = sum(t in w for w in toks.values())
                tf = words.count(t)
                if tf:
                    s += math.log(1 + (len(toks) - df + .5) / (df + .5)) * tf * 2.5 / (
                        tf + 1.5 * (.25 + .75 * len(words) / avg))
            if s:
                scores.append((-round(s, 6), i))
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.doc_id)
    return out


@pytest.mark.parametrize("pairs", [2_000_000, 0])
def test_bm25_both_paths(small, pairs):
    docs, queries, texts, qs = small
    assert lists(lexical.search(queries, docs, 7, max_pairs=pairs)) == brute_bm25(texts, qs, 7)


def test_bm25_paths_agree_on_repeated_ids(spark):
    """Rows of one id are documents of their own, also where they are equal."""
    rows = [("d1", "w1 w2"), ("d1", "w1 w1 w3"), ("d2", "w1"), ("d2", "w1"), ("d3", "w4 w4"), ("d4", "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "w1")], "query_id int, text string")
    known = spark.createDataFrame([("w1",), ("w2",)], "term string")
    for vocabulary in (None, known):
        got = [sorted(map(str, lexical.search(queries, docs, 9, max_pairs=n, vocabulary=vocabulary).collect())) for n in (2_000_000, 0)]
        assert got[0] == got[1] and len(got[0]) == 10


def test_index_on_disk(spark, small, tmp_path):
    docs, queries, texts, qs = small
    lexical.write_index(docs, str(tmp_path))
    assert lexical.index_is_current(docs, str(tmp_path))
    assert not lexical.index_is_current(docs.filter("doc_id > 0"), str(tmp_path))
    assert lists(lexical.search_index(queries, str(tmp_path), 7)) == brute_bm25(texts, qs, 7)


@pytest.mark.parametrize("limit", [64 << 20, 700])
def test_dense_both_paths_with_ties(spark, limit):
    rng = np.random.default_rng(1)
    base = rng.integers(-2, 3, (200, 4)).astype(float)
    base[::3] = base[0]  # a third of all vectors are copies
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    corpus = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>").repartition(6)
    queries = corpus.limit(60).withColumnRenamed("doc_id", "query_id")
    q = {r.query_id: np.array(r.embedding) for r in queries.collect()}
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in q.items()],
                                    "query_id bigint, embedding array<double>")
    got = lists(dense.search(queries, corpus, 9, broadcast_bytes=limit))
    for k, v in q.items():
        order = sorted(range(200), key=lambda i: (-round(float(base[i] @ v), 6), i))
        assert got[k] == order[:9]


def test_topk_is_prefix(small):
    docs, queries, *_ = small
    four, five = (lists(lexical.search(queries, docs, k)) for k in (4, 5))
    assert all(five[q][:4] == four[q] for q in four)


def test_fusion_is_subset_and_ordered_by_first_list(spark):
    schema = "query_id int, doc_id int, rank int, score double"
    a = spark.createDataFrame([(1, 10, 1, .9), (1, 11, 2, .8)], schema)
    b = spark.createDataFrame([(1, 20, 1, 5.), (1, 21, 2, 4.)], schema)
    fused = lists(fusion.reciprocal_rank_fusion([a, b]))
    assert fused == {1: [10, 20, 11, 21]}


def test_empty_lexical_arm_keeps_dense_order(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "zzz yyy"), (2, "  ")], "query_id int, text string")
    got = fusion.hybrid(queries, docs, models.hashing_embedder(), 2).collect()
    assert {r.query_id for r in got} == {1} and len(got) == 2


def test_rerank_skips_strong_queries(spark):
    schema = "query_id int, doc_id int, rank int, score double"
    pool = spark.createDataFrame([(1, 1, 1, .9), (1, 2, 2, .1), (2, 1, 1, .5), (2, 2, 2, .4)], schema)
    docs = spark.createDataFrame([(1, "nothing"), (2, "wanted words")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "wanted"), (2, "wanted")], "query_id int, text string")
    got = fusion.rerank(pool, queries, docs, models.overlap_reranker, 2, .86)
    order = {(r.query_id, r.final_rank): r.doc_id for r in got.collect()}
    assert order == {(1, 1): 1, (1, 2): 2, (2, 1): 2, (2, 2): 1}


def test_embedder_matches_constants(spark):
    texts = ["heart chest pain", "", "the of and"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = np.array([r[0] for r in df.select(models.hashing_embedder()(df.text)).collect()])
    assert np.allclose(got, models.embed_constants(texts))


def test_codes_round_trip(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id as doc_id", "embedding")
    ranges = dense.dimension_ranges(v)
    back = dense.decode(dense.encode(v, ranges), ranges).join(
        v.withColumnRenamed("embedding", "original"), "doc_id").collect()
    step = {r.dim: (r.hi - r.lo) / 255 for r in ranges.collect()}
    for r in back:
        for d, (a, b) in enumerate(zip(r.embedding, r.original)):
            assert abs(a - b) <= step[d] * 1.0001


def test_equal_texts_are_encoded_once(spark):
    df = spark.createDataFrame([(1, "a word"), (2, "a word"), (3, None)], "i int, text string")
    got = {r.i: r.embedding for r in models.embed_distinct(df, models.hashing_embedder()).collect()}
    assert got[1] == got[2] and set(got) == {1, 2, 3}


@pytest.mark.parametrize("cap", [1, 40, 57, 100, 101, 500])
def test_vocabulary_cut_off(spark, cap):
    rng = random.Random(cap)
    counts = [(f"{rng.choice('abc')}{rng.choice('xyzé')}{i}", rng.choice([1, 1, 1, 1, 2, 2, 3, 9])) for i in range(101)]
    df = spark.createDataFrame(counts, "term string, cf long").withColumn("df", lit(1))
    got = sorted((r.term, r.cf) for r in lexical.capped_vocabulary(df, cap).collect())
    assert got == sorted(sorted(counts, key=lambda c: (-c[1], c[0].encode()))[:cap])
    assert lexical.capped_vocabulary(df.limit(0), cap).count() == 0


def test_merging_in_one_step_or_two(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(q, i, float(rng.randint(0, 9))) for q in range(5) for i in range(200)] + [(9, 1, 2.0)]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, score double").repartition(6)
    one = sorted(map(tuple, dense.merge(df, 4).collect()))
    monkeypatch.setattr(dense, "MERGE_TASKS", 0)
    assert sorted(map(tuple, dense.merge(df, 4).collect())) == one and len(one) == 21


def test_vectors_with_nulls_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [0.6, 0.8])]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    got = dense.search(v.withColumnRenamed("doc_id", "query_id"), v, 5)
    assert {(r.query_id, r.doc_id) for r in got.collect()} == {(1, 1), (1, 4), (4, 1), (4, 4)}


def test_cells_give_what_one_matrix_gives(spark, monkeypatch):
    """Repeated vectors and ids, near ties, a zero and a huge vector; the driver gets counts, no query vectors."""
    import numpy as np
    from lensmere.operators import dense

    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(150, 8)), 2)
    v[40:80], v[81], v[100:110] = v[3], 0.0, v[7] + 1e-7
    monkeypatch.setattr(dense, "FIRST_COLUMNS", 16)
    monkeypatch.setattr(dense, "CELL_COLUMNS", 32)
    monkeypatch.setattr(dense, "CELL_ROWS", 40)
    for big in (v, np.vstack([v, np.full((1, 8), 1e200)])):
        ids = [i - (i % 10 == 9) for i in range(len(big))]
        f = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, big)], "doc_id long, embedding array<double>")
        q = f.withColumnRenamed("doc_id", "query_id")
        for low in (None, 0.5):
            want = dense.search(q, f, 6, low).collect()
            monkeypatch.setattr(dense, "_search_broadcast", None)
            have = dense.search(q, f, 6, low, broadcast_bytes=64)
            monkeypatch.undo()
            assert sorted(map(tuple, have.collect())) == sorted(map(tuple, want))
            monkeypatch.setattr(dense, "FIRST_COLUMNS", 16)
            monkeypatch.setattr(dense, "CELL_COLUMNS", 32)
            monkeypatch.setattr(dense, "CELL_ROWS", 40)


def test_scan_spreads_out_a_bounded_number_of_pairs():
    import numpy as np
    from lensmere.operators import lexical

    rng = np.random.default_rng(2)
    rows = np.sort(rng.integers(0, 200, 3000))
    fans = rng.integers(0, 50, 3000)
    blocks = lexical._fan_blocks(rows, fans, 210, most=2000)
    assert [a for a, _ in blocks] == [0, *(b for _, b in blocks[:-1])] and blocks[-1][1] == 210
    for a, b in blocks:
        assert fans[(rows >= a) & (rows < b)].sum() <= 2000 or b == a + 1


def test_cells_and_a_small_vocabulary_move_no_postings(spark, monkeypatch):
    """Nothing is exploded per query or collected per document; several cells, repeated and null ids."""
    from lensmere.operators import lexical

    rows = [(i % 35, " ".join(f"w{(i * j) % 17}" for j in range(i % 9))) for i in range(60)] + [(None, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(q, f"w{q} w{q + 3} w2") for q in range(9)], "query_id long, text string")
    known = spark.createDataFrame([(f"w{i}",) for i in range(0, 17, 2)], "term string")
    monkeypatch.setattr(lexical, "CELL_PAIRS", 7)
    monkeypatch.setattr(lexical, "CELL_DOCS", 20)
    monkeypatch.setattr(lexical, "CELL_QUERIES", 2)
    some = docs.filter("doc_id is not null")
    for words in (None, known):
        want = sorted(map(tuple, lexical.search(queries, some, 4, vocabulary=words).collect()))
        have = lexical.search(queries, some, 4, vocabulary=words, max_pairs=0)
        plan = have._jdf.queryExecution().toString()
        assert "collect_list" not in plan and "FlatMapCoGroups" in plan
        assert sorted(map(tuple, have.collect())) == want and want
    assert lexical.search(queries, docs, 50, max_pairs=0).filter("doc_id is null").count() == 9


def test_many_queries_are_not_scanned(spark, monkeypatch):
    """What a scan keeps is sorted for every block, so many queries go through cells although their terms are few."""
    rng = random.Random(11)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega"], k=rng.randint(0, 6))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = [(q, " ".join(rng.choices(["alpha", "beta", "omega", "nothing"], k=3))) for q in range(9)] + [(None, "gamma"), (3, "alpha delta")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    want = sorted(map(str, lexical.search(queries.filter("query_id is not null"), docs, 5).collect()))
    monkeypatch.setattr(lexical, "MAX_SCANNED_QUERIES", 8)
    monkeypatch.setattr(lexical, "_scores_by_scan", None)
    have = lexical.search(queries, docs, 5).collect()
    assert sorted(str(r) for r in have if r.query_id is not None) == want


@pytest.mark.parametrize("least", [0, 1 / 50, 2])
def test_best_of_a_cell(monkeypatch, least):
    """Products of shared terms, sums of rare ones, or both: the best are those of the plain sums."""
    monkeypatch.setattr(lexical, "SHARED_LEAST", least)
    monkeypatch.setattr(lexical, "CELL_QUERIES", 7)
    rng = np.random.default_rng(4)
    n, n_queries, n_terms, k = 300, 30, 40, 6
    weights = rng.random((n, n_terms)).round(2) * (rng.random((n, n_terms)) < rng.random(n_terms))
    weights[50:80] = weights[20]  # ties
    asked = (rng.random((n_queries, n_terms)) < 0.2) * 1
    asked[3] *= 2  # pairs given twice
    row, term = np.nonzero(weights)
    pair_query, pair_term = (np.repeat(x, asked[asked > 0]) for x in np.nonzero(asked))
    query, place, scores = lexical._best_of_cell((row, term, weights[row, term]), n, (pair_query, pair_term), n_queries, n_terms, k)
    got = list(zip(query.tolist(), place.tolist(), scores.tolist()))
    full = np.floor(asked @ weights.T * 1e6 + 0.5) / 1e6
    want = []
    for q in range(n_queries):
        order = np.lexsort((np.arange(n), -full[q]))[:k]
        want += [(q, d, full[q, d]) for d in order.tolist() if full[q, d] != 0]
    assert got == want


def test_scores_of_large_terms_do_not_depend_on_shapes():
    import numpy as np
    from lensmere.operators import dense

    rng = np.random.default_rng(4)
    q, v = rng.normal(size=(30, 37)), rng.normal(size=(60, 37))
    q[3], v[5], v[6] = 1e200, 0.0, 1e200
    q[4] *= 1e12
    whole = dense._scores(q, v)
    for i in range(len(q)):
        assert (dense._scores(q[i:i + 1], v)[0] == whole[i]).all() and (dense._scores(q[i:], v[7:])[0] == whole[i, 7:]).all()
    assert np.allclose(whole[:3, :5], np.round(q[:3] @ v[:5].T, 6)) and whole[3, 5] == 0 and np.isinf(whole[3, 6])
    assert dense._scores(q[:0], v).shape == (0, 60)


@pytest.mark.parametrize("known", [500_000, 3])
def test_cells_score_documents_a_few_at_a_time(spark, monkeypatch, known):
    """Floors from earlier documents, terms that wait, ties, repeated and null ids; terms as numbers or, if too many, as they are."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(30)]
    often = [1 / (1 + i) for i in range(30)]
    texts = [" ".join(rng.choices(words, often, k=rng.randint(0, 25))) for _ in range(400)]
    texts[60:90] = [texts[59]] * 30
    docs = spark.createDataFrame([(i - (i % 10 == 9), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(q, " ".join(rng.sample(words, 8))) for q in range(40)], "query_id long, text string")
    want = sorted(map(tuple, lexical.search(queries, docs, 6).collect()))
    for name, value in {"MAX_VOCABULARY": known, "MAX_SCANNED_QUERIES": 8, "FIRST_DOCS": 20, "NEXT_DOCS": 50, "NEXT_POSTINGS": 300,
                        "CELL_QUERIES": 7, "CELL_POSTINGS": 900, "BLOCK_QUERIES": 25}.items():
        monkeypatch.setattr(lexical, name, value)
    assert sorted(map(tuple, lexical.search(queries, docs, 6).collect())) == want and len(want) == 240
    none = spark.createDataFrame([(None, t) for t in texts[:9]], "doc_id long, text string")
    assert lexical.search(queries, docs.unionByName(none), 500).filter("doc_id is null").count() > 0


def test_best_of_a_cell_above_a_floor(monkeypatch):
    """A floor leaves out documents below it and nothing else, whatever terms wait."""
    rng = np.random.default_rng(9)
    n, n_queries, n_terms, k = 400, 30, 40, 6
    weights = rng.random((n, n_terms)) * (rng.random((n, n_terms)) < rng.random(n_terms) ** 2) * np.linspace(3, 0.1, n_terms)
    asked = (rng.random((n_queries, n_terms)) < 0.3) * 1
    row, term = np.nonzero(weights)
    pairs = tuple(np.repeat(x, asked[asked > 0]) for x in np.nonzero(asked))
    call = lambda floor: lexical._best_of_cell((row, term, weights[row, term]), n, pairs, n_queries, n_terms, k, floor)
    full = list(zip(*(x.tolist() for x in call(None))))
    for share in (0.5, 0.999, 1):
        floor = np.zeros(n_queries)
        for q in range(0, n_queries, 2):
            floor[q] = share * min(s for a, _, s in full if a == q)
        assert list(zip(*(x.tolist() for x in call(floor)))) == full
        high = floor * 1.2
        assert list(zip(*(x.tolist() for x in call(high)))) == [x for x in full if x[2] >= high[x[0]]]


def test_cells_read_texts_once(spark):
    """Tokens and vectors are costly to make: counting for cells and cutting them takes no further pass."""
    from pyspark.sql.functions import col, udf

    seen = spark.sparkContext.accumulator(0)

    @udf("string")
    def text(i):
        seen.add(1)
        return f"w{i % 7} w{i % 5}"

    @udf("array<double>")
    def vector(i):
        seen.add(1)
        return [1.0, float(i % 7)]

    queries = spark.createDataFrame([(q, f"w{q}", [1.0, float(q)]) for q in range(6)], "query_id long, text string, embedding array<double>")
    docs = spark.range(200, numPartitions=4).select(col("id").alias("doc_id"), text("id").alias("text"))
    assert lexical.search(queries, docs, 5, max_pairs=0).count() == 30 and seen.value == 200
    seen.value = 0
    vectors = spark.range(200, numPartitions=4).select(col("id").alias("doc_id"), vector("id").alias("embedding"))
    assert dense.search(queries, vectors, 5, broadcast_bytes=16).count() == 30 and seen.value == 200


def test_fused_lists_hold_a_document_once(spark):
    """Each list comes in partitions of its own query ids; their union does not."""
    rows = spark.range(4000).selectExpr("id % 400 AS query_id", "id DIV 400 AS doc_id", "1.0D / (1 + id DIV 400) AS score")
    lists = [dense.rank(rows, 8), dense.rank(rows.selectExpr("query_id", "doc_id", "-score AS score"), 8)]
    got = fusion.reciprocal_rank_fusion(lists)
    assert got.groupBy("query_id").count().filter("count <> 10").count() == 0
    assert got.groupBy("query_id", "doc_id").count().filter("count > 1").count() == 0
    key = got.groupBy("query_id").count().join(spark.range(400).withColumnRenamed("id", "query_id"), "query_id")
    assert key.count() == 400 and got.count() == 4000


def test_even_keys(spark):
    from lensmere.tables import even_keys

    keys = even_keys(spark, 13)
    parts = spark.createDataFrame([(x,) for x in keys], "k int").repartition(13, "k").selectExpr("spark_partition_id() AS p")
    assert len(set(keys)) == 13 and parts.distinct().count() == 13
