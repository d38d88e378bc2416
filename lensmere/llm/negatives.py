"""Hard negatives for contrastive training by a secondary-sort shuffle.

Scores of anchors against all rows are computed in cells of an anchor block and a share of the rows.  What
an anchor can use of a cell is packed into keys (anchor, descending score, id), the keys are dealt by
anchor and sorted inside the partitions, and an iterator runs over them once: a row of the anchor's own
label opens a window, rows of other labels that fall into open windows are emitted.  The iterator holds
the open windows of one anchor, never its rows.
"""

from __future__ import annotations

import math
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lensmere.llm import shared
from lensmere.llm.topk_segments import _matrix, exact

POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these percentages of the positive's.
WINDOW = (30, 90)
#: Anchors of one block and rows of one chunk; both travel as matrices, so these bound what a worker holds.
ANCHOR_BLOCK = 2_048
CHUNK_ROWS = 2_048

_KEY = struct.Struct(">QQQBQ")
_TOP = 1 << 63


def packed(anchor: int, print_: int, score: int, negative: bool, vec_id: int) -> bytes:
    """A key whose bytes sort by anchor, anchor row, descending score, positives first, and id."""
    return _KEY.pack(anchor + _TOP, print_ + _TOP, _TOP - 1 - score, negative, vec_id + _TOP)


def unpacked(key: bytes) -> tuple[int, int, int, bool, int]:
    anchor, print_, score, negative, vec_id = _KEY.unpack(key)
    return anchor - _TOP, print_ - _TOP, _TOP - 1 - score, bool(negative), vec_id - _TOP


def _matrices(batches, width: int, rows: int):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, _matrix(part.column("v"), width).astype("<i8").tobytes()


def _chunked(width: int):
    def run(batches):
        for part, data in _matrices(batches, width, CHUNK_ROWS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("label").to_pylist()], pa.list_(pa.int32())),
                 pa.array([data], pa.binary())], names=["ids", "labels", "data"])

    return run


def _blocked(width: int):
    def run(table: pa.Table) -> pa.Table:
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "a_ids": pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())),
            "a_labels": pa.array([table.column("label").to_pylist()], pa.list_(pa.int32())), "prints": pa.array([table.column("print").to_pylist()], pa.list_(pa.int64())),
            "windows": pa.array([table.column("windows").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "a_data": pa.array([_matrix(table.column("v"), width).astype("<i8").tobytes()], pa.binary())})

    return run


class _Anchors:
    """One block of anchors inside a task, and what its rows have seen so far."""

    def __init__(self, row: dict, width: int) -> None:
        self.block = row["block"]
        self.ids, self.labels, self.prints = (np.array(row[c], np.int64) for c in ("a_ids", "a_labels", "prints"))
        self.x = np.frombuffer(row["a_data"], "<i8").reshape(-1, width)
        self.windows = row["windows"]
        self.best: list[dict] = [{} for _ in self.ids]

    def floor(self, i: int, slot: int, most: int) -> int:
        """The score below which a row cannot be among the ``most`` of a slot any more."""
        scores = self.best[i][slot][0] if slot in self.best[i] else ()
        return int(scores[-1]) if len(scores) == most else -_TOP

    def keep(self, i: int, slot: int, scores: np.ndarray, ids: np.ndarray, most: int) -> None:
        if slot in self.best[i]:
            s, k = self.best[i][slot]
            scores, ids = np.append(s, scores), np.append(k, ids)
        if len(scores) > 4 * most:  # leaves all rows of the least score that stays
            near = scores >= np.partition(scores, len(scores) - most)[len(scores) - most]
            scores, ids = scores[near], ids[near]
        top = np.lexsort((ids, ~scores))[:most]
        scores, ids = scores[top], ids[top]
        self.best[i][slot] = scores, ids

    def positives(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, most: int) -> None:
        for i in range(len(self.ids)):
            at = np.flatnonzero((labels == self.labels[i]) & (ids != self.ids[i]) & (scores[:, i] >= self.floor(i, 0, most)))
            if len(at):
                self.keep(i, 0, scores[:, i][at], ids[at], most)

    def negatives(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, most: int, low: int, high: int) -> None:
        for i in range(len(self.ids)):
            if not self.windows[i]:
                continue
            own = scores[:, i]
            other = (labels != self.labels[i]) & (ids != self.ids[i])
            for p in set(self.windows[i]):
                least, greatest = max(-(-low * p // 100), self.floor(i, p, most)), high * p // 100
                at = np.flatnonzero((own >= least) & (own <= greatest) & other)
                if len(at):
                    self.keep(i, p, own[at], ids[at], most)

    def keys(self, negative: bool):
        """(print, key) of all that was kept; a row that several windows hold comes once, repeated rows come again."""
        for anchor, print_, best in zip(self.ids.tolist(), self.prints.tolist(), self.best):
            found: Counter = Counter()
            for scores, ids in best.values():
                found |= Counter(zip(scores.tolist(), ids.tolist()))
            for s, k in found.elements():
                yield print_, packed(anchor, print_, s, negative, k)


def _cells(width: int, most: int, negative: bool, window: tuple[int, int]):
    """Keys of what each anchor of a cell can use: its best rows of its label, or the first of each window."""

    def flushed(now):
        prints, keys = [], []
        for p, k in now.keys(negative):
            prints.append(p)
            keys.append(k)
        return pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(keys, pa.binary())], names=["print", "key"])

    def run(batches):
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                if now is None or now.block != block:
                    if now is not None:
                        yield flushed(now)
                    now = _Anchors({c: batch.column(c)[i].as_py() for c in ("block", "a_ids", "a_labels", "prints", "windows", "a_data")}, width)
                ids, labels = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "labels"))
                x = np.frombuffer(batch.column("data")[i].as_py(), "<i8").reshape(-1, width)
                scores = _products(x, now.x)
                if negative:
                    now.negatives(scores, ids, labels, most, *window)
                else:
                    now.positives(scores, ids, labels, most)
        if now is not None:
            yield flushed(now)

    return run


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """All integer inner products; exact in doubles while they fit, one query at a time beyond."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0))
    if most * x.shape[1] < 2 ** 52:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    return np.stack([exact(x, row) for row in q], 1) if len(q) else np.zeros((len(x), 0), np.int64)


def _mined(positives: int, negatives: int, window: tuple[int, int]):
    """The one pass over sorted keys; windows are (positive, its score, least and greatest score, emitted so far)."""
    low, high = window
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        now, open_, seen, last = None, [], 0, None
        out: list[list] = [[] for _ in names]
        for batch in batches:
            for key in batch.column("key").to_pylist():
                anchor, print_, score, negative, vec_id = unpacked(key)
                if (anchor, print_) != now:
                    now, open_, seen = (anchor, print_), [], 0
                if not negative:
                    if seen < positives:
                        seen += 1
                        open_.append([vec_id, score, 0])
                    continue
                for w in open_:
                    if w[2] < negatives and low * w[1] <= 100 * score <= high * w[1]:
                        w[2] += 1
                        for column, value in zip(out, (anchor, w[0], w[2], vec_id, w[1], score)):
                            column.append(value)
                # A window that is full, or lies above the scores to come, is never met again.
                open_ = [w for w in open_ if w[2] < negatives and low * w[1] <= 100 * score]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                out = [[] for _ in names]

    return run


def hard_negatives(anchors: DataFrame, rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   window: tuple[int, int] = WINDOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both inputs are (vec_id long, label int, v array<long>); scores are integer inner products, higher first,
    ties by smaller id.  An anchor's positives are its first ``positives`` rows of its label.  For each of
    them come the first ``negatives`` rows of another label whose score lies between ``window`` per cent of
    the positive's, both ends included, numbered from 1.

    Rows with a null id, label or vector must be left out before (``quantised`` does it for vectors).  A row
    with the anchor's own id is passed over, whatever it holds.  Repeated rows count each as positives and
    negatives; equal anchor rows are asked once, and an anchor id with different vectors or labels is mined
    for each of them.  Shorter vectors are continued by zeros; products beyond 64 bits stop at the largest
    long.  An empty side gives an empty result.  Columns beyond the three are not read.

    Anchors and rows meet in cells of a block of anchors and a share of the rows, dealt by hash, so neither
    side passes through the driver and a hot label is spread over all cells.  Two passes over the scores: the
    first finds the positives, the second keeps per cell the first negatives of each window, which bounds
    the shuffle by cells x anchors x (positives x negatives) keys instead of all pairs.
    """
    spark = rows.sparkSession
    anchors = shared.staged(anchors.select("vec_id", "label", "v").distinct().withColumn("print", F.xxhash64("vec_id", "label", "v")))
    n = anchors.count()
    rows = rows.select("vec_id", "label", "v")
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = rows.select("v").union(anchors.select("v")).agg(F.max(F.size("v"))).first()[0]
    if not n or width is None:
        return empty
    width = max(width, 1)
    blocks = math.ceil(n / ANCHOR_BLOCK)
    parts = spark.sparkContext.defaultParallelism
    shares = max(1, math.ceil(2 * parts / blocks))
    chunks = shared.staged(rows.mapInArrow(shared.tidy(_chunked(width)), "ids array<long>, labels array<int>, data binary")
                           .withColumn("share", F.pmod(F.xxhash64("ids", F.monotonically_increasing_id()), F.lit(shares)).cast("int")))

    def met(asked: DataFrame, most: int, negative: bool) -> DataFrame:
        block = asked.withColumn("block", F.pmod("print", F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(
            _blocked(width), "block int, a_ids array<long>, a_labels array<int>, prints array<long>, windows array<array<long>>, a_data binary")
        left = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = block.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        # A given number of partitions: the cells are few bytes and much work, and are not to be put together.
        cells = left.repartition(max(2 * parts, blocks * shares), "block", "share").join(right, ["block", "share"]).sortWithinPartitions("block")
        return cells.mapInArrow(shared.tidy(_cells(width, most, negative, window)), "print long, key binary")

    found = met(anchors.withColumn("windows", F.array().cast("array<long>")), positives, False)
    first = Window.partitionBy("print", F.substring("key", 1, 16)).orderBy("key")
    own = shared.staged(found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives).select("print", "key"))
    scores = own.groupBy("print").agg(F.collect_list(_score("key")).alias("windows"))
    keys = met(anchors.join(scores, "print"), negatives, True).union(own)
    # Equal keys are repeated rows: they stay.
    return keys.repartition("print").sortWithinPartitions("key").mapInArrow(shared.tidy(_mined(positives, negatives, window)), empty.schema)


def _score(key: str):
    """The score inside a packed key, as a column."""
    return F.expr(f"9223372036854775807 - cast(conv(hex(substring({key}, 17, 8)), 16, 10) as decimal(20, 0))").cast("long")


def labelled(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, v): components as floor(scale x); rows with a null id, label or vector or a bad component are left out."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(good, F.lit(False))).select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))
