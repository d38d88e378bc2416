"""Rounds of nearest centres and means against numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensmere.operators import models, tree
from lensmere.session import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def by_hand(x, k, rounds):
    ids = sorted(range(len(x)), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:k]
    c = x[ids].copy()
    for n in range(rounds + 1):
        d = np.round((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 6)
        own = d.argmin(1)
        if n < rounds:
            for j in range(k):
                if (own == j).any():
                    c[j] = x[own == j].mean(0)
    return own


@pytest.mark.parametrize("limit", [64 << 20, 8 * 5 * 3])
def test_rounds(spark, tmp_path, limit, monkeypatch):
    """Two thirds of all vectors are copies, some centres lose all members; centres in one block and in many."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 5)).round(2)
    x[::3] = x[0]
    x[1::3] = x[1]
    monkeypatch.setattr(tree, "SUM_VALUES", 11)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>").repartition(7)
    got = {r.doc_id: r.cluster for r in tree.lloyd(df, 12, str(tmp_path), 4, limit).collect()}
    assert [got[i] for i in range(240)] == by_hand(x, 12, 4).tolist()
    assert sorted(p.name for p in (tmp_path / "centres").iterdir()) == [f"round={n}" for n in range(5)]


def test_blocks_of_centres(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id as doc_id", "embedding")
    centres = v.filter("doc_id % 3 = 0").selectExpr("doc_id as cluster", "embedding")
    one, many = (sorted(map(tuple, tree.assign(v, centres, broadcast_bytes=n).collect())) for n in (64 << 20, 8 * 64 * 40))
    assert one == many and len(one) == 500


def test_means_of_nothing_and_of_names(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0]), ("c", None)], "cluster string, embedding array<double>")
    assert {r.cluster: (r.n, r.embedding) for r in tree.means(rows).collect()} == {"a": (2, [2.0, 3.0]), "b": (1, [5.0, 6.0])}
    assert tree.means(rows.limit(0)).count() == 0


def test_upper_level_needs_two_topics_a_domain(spark, tmp_path):
    embed = models.hashing_embedder()
    texts = [(i, f"word{i % 4} and word{i % 4} of theme {i % 4}") for i in range(40)]
    t = spark.createDataFrame(texts, "doc_id long, text string").withColumn("question", F.lit(None).cast("string"))
    v = t.select("doc_id", embed(F.col("text")).alias("embedding"))
    made = {d: tree.levels(v, t, embed, 8, d, str(tmp_path / str(d)), 3) for d in (1, 30)}
    levels = {d: {r.level for r in n.collect()} for d, n in made.items()}
    assert levels[30] == {1} and levels[1] <= {1, 2}
