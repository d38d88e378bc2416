"""Importance resampling against plain Python, and the interning table against dictionaries."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402
from lensmere.llm import resampling  # noqa: E402
from lensmere.session import ship  # noqa: E402


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def features(text, low, high):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain.low(text or ""))
    return [" ".join(w[i:i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)], len(w)


def by_hand(docs, target, low=1, high=1, buckets=10_000, percent=10, least=20, seed=2024):
    own, wanted = Counter(), Counter()
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    for _, t in docs:
        own.update(map(crc, features(t, low, high)[0]))
    for t in target:
        wanted.update(map(crc, features(t, low, high)[0]))
    s, t = sum(own.values()) + buckets, sum(wanted.values()) + buckets
    out = []
    for k, text in docs:
        f, words = features(text, low, high)
        g = [math.floor(1000 * math.log((wanted[b] + 1) * s / ((own[b] + 1) * t))) for b in map(crc, f)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    open_ = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(open_[:percent * len(open_) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_hashes_are_xxhash():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    starts, lengths = rng.integers(0, 3000, 400), rng.integers(0, 300, 400)
    raw = data.tobytes()
    assert resampling.xxhash64(data, starts, lengths).tolist() == [xxhash.xxh64_intdigest(raw[a:a + m]) for a, m in zip(starts, lengths)]


@pytest.mark.parametrize("alike", [False, True])
def test_interning_verifies_bytes(alike):
    """With true keys, and with one key for all n-grams, equal spans share a slot and others don't."""
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab\xc3") for _ in range(rng.choice([1, 2, 3, 8, 9, 17, 40]))) for _ in range(300)]
    words += rng.choices(words, k=300)
    lengths = np.array([len(w) for w in words])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    table = resampling.Interned(np.frombuffer(b"".join(words), np.uint8), starts, lengths, 97, np.full(600, 7, np.uint64) if alike else None)
    slots = {}
    for w, s in zip(words, table.slots.tolist()):
        assert slots.setdefault(w, s) == s and table.buckets[s] == zlib.crc32(w) % 97
    assert len(set(slots.values())) == len(slots) == len(table.used)
    assert {w: int(table.counts[s]) for w, s in slots.items()} == Counter(words)


@pytest.mark.parametrize("low, high", [(1, 1), (1, 2), (2, 3)])
def test_against_plain(spark, low, high):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcÄß你0Z") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 19, 20, 21, 60])))) for i in range(120)]
    target = [" ".join(rng.choices(vocabulary[:15], k=30)) for _ in range(10)]
    got = resampling.scored(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"),
                            low=low, high=high, percent=30)
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(docs, target, low, high, percent=30)


def test_odd_rows(spark):
    long = "word " * 40000 + "x" * 90000
    docs = [(1, None), (2, ""), (3, " .,;\x00\x7f"), (None, "null id " * 20), (None, None), (4, long), (5, "same row " * 15), (5, "same row " * 15), (5, "other " * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for c in ("key", "n_features", "score", "rank", "bucket", "n", "_block"):
        df = df.withColumn(c, F.lit("clash"))
    target = spark.createDataFrame([("word same",), (None,)], "text string").withColumn("bucket", F.lit(1))
    got = resampling.scored(df, target, percent=60)
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(docs, ["word same"], percent=60)
    rows = resampling.drawn(df, target, percent=60)
    assert rows.columns == df.columns and rows.count() > 0
    assert resampling.scored(df.limit(0), target).count() == 0
    assert resampling.scored(df, target.limit(0)).count() == len(docs)
