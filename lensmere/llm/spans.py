"""Substring dedup by sliding spans of sentences.

Every run of a few consecutive sentences is hashed and joined over all documents.  A run that occurs
more than once belongs to its first place, and sentences covered by it elsewhere are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lensmere.llm import flat, shared

RUN = 3
#: A longer sentence is cut where its words decide, and after so many words at the latest, so that it holds runs of its own.
LONGEST = 16
#: A long sentence is cut before the second word of a pair whose hash is the least among so many pairs on either side.
AROUND = 4
#: Words of a covered stretch that is removed: any, the size of a run is the only measure.
LEAST_WORDS = 1

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b"\"')]")] = True
_LINE = np.zeros(256, bool)
_LINE[list(b"\n\r")] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)
_OTHER = np.random.Generator(np.random.PCG64(53)).integers(1, 1 << 63, 256, dtype=np.uint64)


def _cuts(h: np.ndarray, first: np.ndarray, longest: int, around: int = AROUND) -> np.ndarray:
    """Where sentences of more than ``longest`` words are cut; ``first`` has the words that begin one.

    A cut depends on the words next to it alone, so equal passages are cut alike wherever in a sentence they
    begin.  Of equal pairs the first counts, so cuts stand more than ``around`` words apart, and as far from
    the ends of the sentence.
    """
    n = len(h)
    pair = np.zeros(n, np.uint64)
    pair[1:] = flat.mix(h[:-1] * _STEP + h[1:])
    least = np.ones(n, bool)
    for d in range(1, around + 1):
        least[d:] &= pair[d:] < pair[:-d]
        least[:-d] &= pair[:-d] <= pair[d:]
    sizes = np.diff(np.append(first, n))
    place, size = np.arange(n) - np.repeat(first, sizes), np.repeat(sizes, sizes)
    return least & (size > longest) & (place > around) & (place + around < size)


def _bytes_summed(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A second value of each word, from its bytes again."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_OTHER[low] * flat._powers.to(len(low) + 1)[0][:len(low)])))
    return flat.mix((sums[ends] - sums[starts]) * flat._powers.to(len(low) + 1)[1][starts])


class Units:
    """The sentences of a group of texts: byte starts, words, two hashes, and offsets by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST) -> None:
        low = flat._LOWER[data]
        starts, ends, rows = flat.words(low, offsets)
        n = len(starts)
        self.rows = np.zeros(len(offsets), np.int64)
        if not n:
            self.starts = self.words = np.zeros(0, np.int64)
            self.hashes = self.others = np.zeros(0, np.uint64)
            return
        stop = _STOP[data[ends - 1]]
        stop |= _CLOSE[data[ends - 1]] & _STOP[data[np.maximum(ends - 2, 0)]] & (ends - starts > 1)
        lines = np.concatenate(([0], np.cumsum(_LINE[data])))
        stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
        begins = np.ones(n, bool)
        begins[1:] = stop[:-1]
        begins[rows[:-1][np.diff(rows) > 0]] = True
        h = flat.span_hashes(low, starts, ends)
        begins |= _cuts(h, np.flatnonzero(begins), longest)
        first = np.flatnonzero(begins)
        size = np.diff(np.append(first, n))
        place, rest = np.arange(n) - np.repeat(first, size), np.repeat(first + size, size) - np.arange(n)
        unit = np.flatnonzero((place == 0) | (place % longest == 0) & (rest > AROUND))
        ends_at = np.append(unit[1:], n)
        up, down = flat._powers.to(n + 1)

        def whole(of_words: np.ndarray) -> np.ndarray:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(of_words * up[:n], out=sums[1:])
            return flat.mix((sums[ends_at] - sums[unit]) * down[unit])

        self.hashes, self.others = whole(h), whole(flat.mix(h ^ _SALT) + _bytes_summed(low, starts, ends))
        self.words = ends_at - unit
        self.starts = starts[unit]
        self.rows = np.searchsorted(unit, rows)

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first sentence within it, two hashes) of every run; a shorter text is one run as a whole."""
        counts = np.diff(self.rows)
        n = len(self.hashes)
        text = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(n) - np.repeat(self.rows[:-1], counts)
        keep = place <= np.maximum(counts - size, 0)[text]
        ends = np.repeat(self.rows[1:], counts)
        out = []
        for hashes in (self.hashes, self.others):
            whole = np.zeros(n, np.uint64)
            for k in range(size):
                part = np.zeros(n, np.uint64)
                part[:max(0, n - k)] = hashes[k:]
                whole = flat.mix(whole * _STEP + np.where(ends > np.arange(n) + k, part, 0).astype(np.uint64) + np.uint64(k + 1))
            out.append(whole[keep])
        return text[keep], place[keep], *out


def _runs(size: int, longest: int):
    def run(batches):
        for batch in batches:
            for first, data, offsets in flat.groups(batch.column("text")):
                text, place, hashes, others = Units(data, offsets, longest).runs(size)
                at = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(others.view(np.int64)), batch.column("key").take(at), batch.column("mark").take(at),
                     pa.array(place.astype(np.int32))], names=["hash", "other", "key", "mark", "place"])

    return run


def cut(text: bytes, places: list[int], size: int, longest: int, least: int) -> tuple[bytes, int]:
    """(text without the sentences that runs at these places cover, words removed)."""
    units = Units(np.frombuffer(text, np.uint8), np.array([0, len(text)]), longest)
    n = len(units.words)
    covered = np.zeros(n + 1, bool)
    for p in places:
        covered[p:min(n, p + size)] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered)).astype(np.int8)))
    totals = np.concatenate(([0], np.cumsum(units.words)))
    bounds = np.append(units.starts, len(text))
    out, at, removed = [], 0, 0
    for a, b in zip(edges[::2], edges[1::2]):
        if totals[b] - totals[a] >= least:
            out.append(text[at:bounds[a]])
            at = bounds[b]
            removed += int(totals[b] - totals[a])
    if not removed:
        return text, 0
    out.append(text[at:])
    return b"".join(out).strip(b" \t\n\r\f\v"), removed


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = RUN, longest: int = LONGEST,
                    least: int = LEAST_WORDS) -> DataFrame:
    """The rows with ``text`` cut and ``removed_words`` added.

    A run of ``size`` consecutive sentences (words compared with A-Z lower-cased, whatever the white space)
    belongs to the smallest key and place that holds it; elsewhere, within a document too, its sentences are
    removed where the covered stretch has ``least`` words or more.  A text of fewer sentences is one run.
    Sentences end at ``.``, ``!``, ``?`` (a closing quote or bracket may follow) or a line end; one of more
    than ``longest`` words is cut into several at places that its words decide, and else after ``longest``
    words; no part of a cut sentence has fewer than five words.

    A null or empty text stays as it is; a text that is removed whole becomes empty.  Rows that repeat key
    and text are one document; equal texts under different keys are copies, the smallest key keeps its text.
    A null key comes before all others.  An empty table gives an empty result.  Other columns are passed
    on, whatever their names; one named ``removed_words`` is replaced.  Runs are told apart by 128 bits, the
    texts of one key by 64.
    """
    kept = [c for c in docs.columns if c != "removed_words"]
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.struct(*kept).alias("row"))
    kind = rows.schema["key"].dataType
    # Written first: Spark splits a hot run in a join only where both sides come straight from a shuffle.
    runs = shared.staged(rows.select("key", "mark", F.col(f"row.{text}").alias("text")).mapInArrow(shared.tidy(_runs(size, longest)), T.StructType([
        T.StructField("hash", T.LongType()), T.StructField("other", T.LongType()), T.StructField("key", kind), T.StructField("mark", T.LongType()),
        T.StructField("place", T.IntegerType())])))
    often = shared.staged(runs.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    repeated = shared.staged(runs.join(often, "hash"))
    shared.dropped(runs)
    firsts = shared.staged(repeated.groupBy("hash", "other").agg(F.min(F.struct("key", "mark", "place")).alias("first")))
    later = (repeated.join(firsts, ["hash", "other"]).where(~F.struct("key", "mark", "place").eqNullSafe(F.col("first")))
             .groupBy("key", "mark").agg(F.sort_array(F.collect_set("place")).alias("places")).withColumnsRenamed({"key": "k", "mark": "m"}))
    joined = rows.join(later, F.col("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m")), "left").select("row", "places")

    def run(batches):
        for batch in batches:
            row, places = batch.column("row"), batch.column("places")
            removed = np.zeros(len(row), np.int64)
            if places.null_count < len(places):
                new = row.field(kept.index(text)).to_pylist()
                for i, p in enumerate(places.to_pylist()):
                    if p and new[i]:
                        out, removed[i] = cut(new[i].encode(), p, size, longest, least)
                        new[i] = out.decode()
                row = pa.StructArray.from_arrays([pa.array(new, pa.string()) if c == text else row.field(i) for i, c in enumerate(kept)], fields=list(row.type))
            yield pa.RecordBatch.from_arrays([row, pa.array(removed)], names=["row", "removed"])

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("removed", T.LongType())])
    return joined.mapInArrow(shared.tidy(run), schema).select("row.*", F.col("removed").alias("removed_words"))
