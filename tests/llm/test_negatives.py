"""Hard negatives against plain Python."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lensmere.llm import negatives  # noqa: E402
from lensmere.session import ship  # noqa: E402


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def by_hand(anchors, rows, positives=5, most=10, low=30, high=90):
    """Rows are (id, label, integers); anchors are asked once each."""
    out = []
    for a, label, x in sorted(set(anchors)):
        scored = sorted((-sum(p * q for p, q in zip(x, y)), k, own) for k, own, y in rows if k != a)
        for p, positive, _ in [r for r in scored if r[2] == label][:positives]:
            fit = [(s, k) for s, k, own in scored if own != label and low * -p <= 100 * -s <= high * -p]
            out += [(a, positive, i + 1, k, -p, -s) for i, (s, k) in enumerate(fit[:most])]
    return sorted(out)


def run(spark, anchors, rows, **options):
    kind = "vec_id long, label int, v array<long>"
    a, b = (spark.createDataFrame([(k, c, list(x)) for k, c, x in t], kind).withColumn("key", F.lit("clash")).withColumn("block", F.lit(1.5)) for t in (anchors, rows))
    return sorted(map(tuple, negatives.hard_negatives(a, b, **options).collect()))


def test_keys_sort_like_their_parts():
    rng = random.Random(1)
    parts = [(rng.choice([-2**63, -1, 0, 5, 2**63 - 1]), rng.choice([-3, 4]), rng.choice([-2**63, -7, 0, 7, 2**63 - 1]), rng.random() < 0.5, rng.choice([-9, 0, 9]))
             for _ in range(300)]
    assert [negatives.unpacked(negatives.packed(*p)) for p in parts] == parts
    assert sorted(parts, key=lambda p: negatives.packed(*p)) == sorted(parts, key=lambda p: (p[0], p[1], -p[2], p[3], p[4]))


@pytest.mark.parametrize("block", [7, 2048])
def test_against_plain(spark, monkeypatch, block):
    """Several blocks of anchors; many ties, scores of 0 and below, a hot label."""
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", block)
    rng = random.Random(block)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 3]), tuple(rng.randint(-2, 3) for _ in range(6))) for i in range(400)]
    anchors = [r for r in rows if r[0] % 9 == 0]
    got = run(spark, anchors, rows)
    assert got == by_hand(anchors, rows) and len(got) > 1000


def test_other_parameters(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, tuple(rng.randint(-9, 9) for _ in range(4))) for i in range(120)]
    assert run(spark, rows[:30], rows, positives=2, negatives=3, window=(50, 100)) == by_hand(rows[:30], rows, 2, 3, 50, 100)


def test_odd_rows(spark):
    """Repeated rows, an id of two rows, anchors without positives or negatives, unequal lengths, large numbers, nothing."""
    rows = [(1, 0, (9, 0)), (2, 0, (9, 0)), (2, 0, (9, 0)), (3, 1, (5, 0)), (3, 1, (5, 0)), (3, 2, (4, 1)), (4, 7, (0, 0)), (5, 0, (3,)), (-6, 1, (6, 1, 0)), (7, 0, ())]
    padded = [(k, c, (*x, 0, 0, 0)[:3]) for k, c, x in rows]
    anchors = [rows[0], rows[0], rows[3], rows[5], rows[6], rows[9]]
    assert run(spark, anchors, rows) == by_hand([padded[i] for i in (0, 3, 5, 6, 9)], padded)
    far = [(1, 0, (2**40, 1)), (2, 0, (2**20, 5)), (3, 1, (2**19, 1)), (4, 1, (2**18, 0))]
    assert run(spark, far[:1], far) == by_hand(far[:1], far) != []
    assert run(spark, [], rows) == [] and run(spark, anchors, []) == []


def test_rows_that_take_no_part(spark):
    rows = [(1, 0, [0.5, -0.25]), (2, None, [0.5, 0.5]), (3, 0, None), (4, 0, [None, 1.0]), (5, 0, [float("nan"), 1.0]), (6, 0, [float("inf"), 1.0]), (None, 0, [1.0]), (7, 1, [])]
    got = negatives.labelled(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("v", F.lit(1)))
    assert [tuple(r) for r in got.collect()] == [(1, 0, [128, -64]), (7, 1, [])]
