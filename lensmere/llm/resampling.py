"""Importance resampling towards a target distribution by hashed n-gram features.

Two bags of n-grams, of the documents and of target texts, are counted in hash buckets; a document's
weight is the mean log ratio of its buckets, and the documents drawn are those of the highest weight plus
Gumbel noise, which is drawing without replacement in proportion to the weights.

Inside a batch every n-gram is interned in an open-addressed NumPy table: its xxhash64 is the key, equal
keys are verified by their bytes, and a slot holds the n-gram's bucket and count.  Buckets are therefore
computed once per distinct n-gram, and occurrences gather what they need by slot.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lensmere.llm import flat, shared
from lensmere.operators.running import running_count

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 2024

# Fixed values of the 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

_WORD = np.ones(256, bool)
_WORD[:0x80] = False
_WORD[0x30:0x3A] = True
_WORD[0x61:0x7B] = True


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lanes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with room behind them, the 8 bytes from each place, the 4 bytes from each place)."""
    room = np.concatenate((data, np.zeros(8, np.uint8)))
    n = len(room)
    return room, np.ndarray((n - 7,), "<u8", room, 0, (1,)), np.ndarray((n - 3,), "<u4", room, 0, (1,))


def xxhash64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """xxHash (64 bits, seed 0) of many spans of one byte array at a time."""
    room, by8, by4 = _lanes(data)
    n = len(starts)
    h = np.full(n, _P5, np.uint64)
    at = starts.astype(np.int64)
    ends = at + lengths
    long = np.flatnonzero(lengths >= 32)
    if len(long):
        zero = np.zeros(len(long), np.uint64)
        v = [zero + _P1 + _P2, zero + _P2, zero, zero - _P1]
        own = np.arange(len(long))
        while len(own):
            place = at[long[own]]
            for k in range(4):
                v[k][own] = _turned(v[k][own] + by8[place + 8 * k] * _P2, 31) * _P1
            at[long[own]] += 32
            own = own[at[long[own]] + 32 <= ends[long[own]]]
        whole = _turned(v[0], 1) + _turned(v[1], 7) + _turned(v[2], 12) + _turned(v[3], 18)
        for x in v:
            whole = (whole ^ (_turned(x * _P2, 31) * _P1)) * _P1 + _P4
        h[long] = whole
    h += lengths.astype(np.uint64)
    own = np.flatnonzero(at + 8 <= ends)
    while len(own):
        h[own] = _turned(h[own] ^ (_turned(by8[at[own]] * _P2, 31) * _P1), 27) * _P1 + _P4
        at[own] += 8
        own = own[at[own] + 8 <= ends[own]]
    own = np.flatnonzero(at + 4 <= ends)
    if len(own):
        h[own] = _turned(h[own] ^ (by4[at[own]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[own] += 4
    own = np.flatnonzero(at < ends)
    while len(own):
        h[own] = _turned(h[own] ^ (room[at[own]].astype(np.uint64) * _P5), 11) * _P1
        at[own] += 1
        own = own[at[own] < ends[own]]
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ (h >> np.uint64(32))


def _same(by8: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Do the spans that begin at a and b, of equal lengths, hold the same bytes?"""
    out = np.ones(len(a), bool)
    left, own, k = lengths.astype(np.int64), np.flatnonzero(a != b), 0
    while len(own):
        rest = left[own] - 8 * k
        mask = np.where(rest >= 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * np.clip(rest, 0, 7).astype(np.uint64))) - np.uint64(1))
        equal = ((by8[a[own] + 8 * k] ^ by8[b[own] + 8 * k]) & mask) == 0
        out[own[~equal]] = False
        own, k = own[equal & (rest > 8)], k + 1
    return out


class Interned:
    """The n-grams of a batch in an open-addressed table: the slot of every occurrence, bucket and count of every slot."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, buckets: int, keys: np.ndarray | None = None) -> None:
        n = len(starts)
        keys = xxhash64(data, starts, lengths) if keys is None else keys
        size = 1 << max(4, int(2 * n).bit_length())
        by8 = _lanes(data)[1]
        holder = np.full(size, -1, np.int64)
        self.slots = np.zeros(n, np.int64)
        open_, slot = np.arange(n), (keys & np.uint64(size - 1)).astype(np.int64)
        while len(open_):
            free = holder[slot] < 0
            holder[slot[free]] = open_[free]
            there = holder[slot]
            same = (keys[there] == keys[open_]) & (lengths[there] == lengths[open_])
            at = np.flatnonzero(same)
            same[at] = _same(by8, starts[there[at]], starts[open_[at]], lengths[open_[at]])
            self.slots[open_[same]] = slot[same]
            open_, slot = open_[~same], (slot[~same] + 1) & (size - 1)
        self.counts = np.bincount(self.slots, minlength=size)
        self.used = np.flatnonzero(holder >= 0)
        self.buckets = np.zeros(size, np.int64)
        raw = memoryview(np.ascontiguousarray(data))
        first = starts[holder[self.used]].tolist()
        for s, a, m in zip(self.used.tolist(), first, lengths[holder[self.used]].tolist()):
            self.buckets[s] = zlib.crc32(raw[a:a + m]) % buckets


def _grams(data: np.ndarray, offsets: np.ndarray, low: int, high: int):
    """(bytes, starts, lengths, texts' offsets, words of each text) of all runs of ``low`` to ``high`` words."""
    plain = flat._LOWER[data]
    inside = _WORD[plain]
    cut = np.zeros(len(plain) + 1, bool)
    cut[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    rows = np.searchsorted(starts, offsets)
    words = np.diff(rows)
    if high > 1 and len(starts):  # the words again, one space after each, so that every run of them is one span
        sizes = ends - starts
        put = np.concatenate(([0], np.cumsum(sizes + 1)))
        joined = np.full(put[-1], 32, np.uint8)
        joined[np.repeat(put[:-1] - starts, sizes) + np.flatnonzero(inside)] = plain[inside]
        plain, starts, ends = joined, put[:-1], put[:-1] + sizes
    text = np.repeat(np.arange(len(words)), words)
    parts = []
    for n in range(low, high + 1):
        first = np.arange(max(0, len(starts) - n + 1))
        first = first[text[first] == text[first + n - 1]]
        parts.append((text[first], starts[first], ends[first + n - 1] - starts[first]))
    text, starts, lengths = (np.concatenate(x) for x in zip(*parts))
    if high > low:
        order = np.argsort(text, kind="stable")
        text, starts, lengths = text[order], starts[order], lengths[order]
    return plain, starts, lengths, np.searchsorted(text, np.arange(len(words) + 1)), words


def _counted(low: int, high: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in flat.groups(batch.column("text")):
                data, starts, lengths, _, _ = _grams(data, offsets, low, high)
                if len(starts):
                    grams = Interned(data, starts, lengths, buckets)
                    np.add.at(total, grams.buckets[grams.used], grams.counts[grams.used])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text: str = "text", low: int = 1, high: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of n-grams in each bucket over all texts; only sums of ``buckets`` numbers reach the driver."""
    rows = (texts.select(F.col(text).alias("text")).mapInArrow(shared.tidy(_counted(low, high, buckets)), "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the documents."""
    n, size, wanted = len(own), int(own.sum()) + len(own), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((int(target[b]) + 1) * size / ((int(own[b]) + 1) * wanted))) for b in range(n)], np.int64)


def _weighed(table: np.ndarray, low: int, high: int):
    def run(batches):
        for batch in batches:
            n, m, weight = [], [], []
            for _, data, offsets in flat.groups(batch.column("text")):
                data, starts, lengths, rows, words = _grams(data, offsets, low, high)
                sums = np.zeros(len(starts) + 1, np.int64)
                if len(starts):
                    grams = Interned(data, starts, lengths, len(table))
                    np.cumsum(table[grams.buckets][grams.slots], out=sums[1:])
                count = np.diff(rows)
                n.append(count)
                m.append(words)
                weight.append((sums[rows[1:]] - sums[rows[:-1]]) // np.maximum(count, 1))
            arrays = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (n, m, weight)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays], names=["key", "n_features", "n_words", "weight"])

    return run


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(1000 g) with g from the Gumbel law, drawn by the sha256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", low: int = 1, high: int = 1,
           buckets: int = BUCKETS, percent: int = 10, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank) of every document; ``rank`` is null for those that are not drawn.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.  The features of a
    text are its runs of ``low`` to ``high`` words.  Of the N documents of ``least_words`` words or more,
    floor(percent N / 100) of the highest scores are drawn; ties go to the smaller key, a null key last.

    A null or empty text has no features and weight 0.  Every row is a document: rows of one key draw the
    same noise, equal rows are ranked in any order among themselves.  An empty table gives an empty result,
    an empty target equal gains by rarity.  Only key and text of the input are read, so other columns do not
    matter.  Texts are read twice, to count and to weigh; the driver holds two numbers a bucket.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    table = gains(bucket_counts(docs, "text", low, high, buckets), bucket_counts(target, text, low, high, buckets))
    kind = docs.schema["key"].dataType.simpleString()
    weighed = docs.mapInArrow(shared.tidy(_weighed(table, low, high)), f"key {kind}, n_features long, n_words long, weight long")
    rows = shared.staged(weighed.withColumn("score", F.col("weight") + noise(F.col("key"), seed)))
    open_ = rows.where(F.col("n_words") >= least_words)
    most = percent * open_.count() // 100
    # Documents are numbered within each score, and scores carry the number of those before them.
    ranked = running_count(open_, [], [F.col("key").asc_nulls_last(), "n_features", "n_words"], -F.col("score"), "rank")
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank").cast("long"))).unionByName(rest).select(
        F.col("key").alias(key), "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose key is drawn; parameters and odd rows as in ``scored``."""
    keys = scored(docs, target, key=key, **options).where("rank is not null").select(F.col(key).alias("_drawn")).distinct()
    return docs.join(keys, docs[key].eqNullSafe(keys["_drawn"]), "left_semi")
