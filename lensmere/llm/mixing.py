"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is permuted by hash and cut into blocks.  A source's quota is a number of block copies:
whole passes over it and a last, partial one.  A binary tree over the output shards splits the quotas:
each node draws from a multivariate hypergeometric law how many blocks of every source go to its left
half, so the shards' counts add up to the quotas exactly.  A shard then takes the next blocks of each
source's permutation, disjoint from all others', and its documents are shuffled locally.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lensmere.llm import shared

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SEED = 20_24
SLICE_BITS = 16
BLOCK_WORDS = 50_000
SHARD_WORDS = 2_000_000


def words_in(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> list[float]:
    """Target words per source, given in order; together as many as the sources have.

    Shares follow the weights; a source stops at ``most`` times its size, and the excess goes to the
    others by weight until none is above.
    """
    out = [0.0] * len(sizes)
    left, open_ = float(sum(n for _, n in sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i % len(weights)] for i in open_)
        full = [i for i in open_ if most * sizes[i][1] < unit * weights[i % len(weights)]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i % len(weights)]
            break
        for i in full:
            out[i] = float(most * sizes[i][1])
            left -= out[i]
            open_.remove(i)
    return out


def shard_counts(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) per source of the block copies that one shard takes: the path of the tree to it."""
    first, own, low, high = np.zeros_like(quotas), quotas.copy(), 0, shards
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        take = round(int(own.sum()) * (mid - low) / (high - low))
        left = _hypergeometric(rng, own, take)
        if shard < mid:
            own, high = left, mid
        else:
            first, own, low = first + left, own - left, mid
    return first, own


def _hypergeometric(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """How many of each kind are among ``take`` drawn without replacement."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, n in enumerate(counts):
        n = int(n)
        if take and n:
            out[i] = rng.hypergeometric(n, rest - n, take) if rest > n else take
        take -= int(out[i])
        rest -= n
    return out


def planned(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
            most: int = MOST_TIMES, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``.

    ``mix_copies`` is an array of (pass, shard, place): the times the mix takes the document, the output
    shard of each, and a number to order the shard by.  A source's copies hold its target of words up to
    the size of one document (rows of equal key and size are taken or left together); no document is taken
    more than ``most`` times.  Sources are in order of code points, null last, and weigh ``weights`` in turn.

    A null or empty text has size 0 and adds no words.  A null key is a key like any other.  An empty table
    gives an empty result, a table without words takes none.  Other columns are passed on; those named like
    a new column are replaced, and names that begin with ``_mix_`` are reserved.  The same rows, seed and sizes give the same mix.

    The driver holds a row per source; the tree is walked by Spark, one row per shard.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    rows = docs.withColumn("_mix_size", words_in(F.col(text)))
    rows = rows.withColumn("_mix_draw", F.xxhash64(F.lit(seed), F.col(key), F.col("_mix_size")))
    rows = rows.withColumn("_mix_slice", F.shiftrightunsigned("_mix_draw", 64 - SLICE_BITS).cast("int"))

    slim = shared.staged(rows.select(F.col(source).alias("source"), F.struct("_mix_draw", F.col(key).alias("key")).alias("at"),
                                     F.col("_mix_slice").alias("slice"), F.col("_mix_size").alias("size")))
    slices = shared.staged(slim.groupBy("source", "slice").agg(F.sum("size").alias("words")))
    totals = slices.groupBy("source").agg(F.sum("words").alias("words")).collect()
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [(r.source, r.words) for r in totals]
    wanted = targets(sizes, weights, most)
    plan = []
    for i, ((name, size), target) in enumerate(zip(sizes, wanted)):
        passes = min(most, int(target // size)) if size else 0
        shift = max(0, min(SLICE_BITS, int(math.log2(max(1.0, (block_words << SLICE_BITS) / max(1, size))))))
        plan.append((i, name, size, target, passes, target - passes * size if passes < most else 0.0, shift))
    table = spark.createDataFrame(plan, "number int, source string, total long, target double, passes int, rest double, shift int")

    # The block in which the last pass of each source ends, and the row at which it ends.
    blocks = (slices.join(F.broadcast(table), slices.source.eqNullSafe(table.source)).drop(table.source)
              .groupBy("number", "rest", F.expr("slice >> shift").alias("block")).agg(F.sum("words").alias("words")))
    run = Window.partitionBy("number").orderBy("block")
    ended = (blocks.withColumn("before", F.sum("words").over(run) - F.col("words")).where("before <= rest")
             .groupBy("number").agg(F.max(F.struct("block", "before")).alias("e")).select("number", "e.*"))
    ends = {r.number: (r.block, r.before) for r in ended.collect()}
    plan = [(*p, *ends.get(p[0], (0, 0))) for p in plan]
    table = spark.createDataFrame(plan, table.schema.add("block", T.IntegerType()).add("before", T.LongType()))
    inside = (slim.join(F.broadcast(table), slim.source.eqNullSafe(table.source)).drop(table.source)
              .where("(slice >> shift) = block and rest > 0"))
    run = Window.partitionBy("number").orderBy("at")
    last = (inside.groupBy("number", "at", "before", "rest").agg(F.sum("size").alias("words"))
            .withColumn("so_far", F.sum("words").over(run) + F.col("before"))
            # Taken while that brings the source nearer to its target.
            .where("so_far - rest <= rest - (so_far - words)")
            .groupBy("number").agg(F.max("at").alias("stop")))
    stops = {r.number: (r.stop["_mix_draw"], r.stop["key"]) for r in last.collect()}
    kind = slim.schema["at"].dataType
    table = spark.createDataFrame([(*p, stops.get(p[0])) for p in plan], table.schema.add("stop", kind))

    # Quotas in block copies, dealt to the shards.
    counts = np.array([p[4] * (1 << SLICE_BITS - p[6]) + (p[7] + 1 if p[5] > 0 else 0) for p in plan] or [0], np.int64)
    shards = max(1, math.ceil(sum(n for _, n in sizes) / shard_words))
    per_pass = [1 << SLICE_BITS - p[6] for p in plan] or [1]

    def walk(batches):
        import pandas as pd

        for batch in batches:
            for shard in batch["id"]:
                first, own = shard_counts(counts, shards, int(shard), seed)
                for i in np.flatnonzero(own):
                    copies = np.arange(first[i], first[i] + own[i])
                    yield pd.DataFrame({"number": np.int32(i), "block": (copies % per_pass[i]).astype(np.int32),
                                        "pass": (copies // per_pass[i]).astype(np.int32), "shard": np.int32(shard)})

    dealt = (spark.range(0, shards, 1, min(shards, spark.sparkContext.defaultParallelism))
             .mapInPandas(walk, "number int, block int, pass int, shard int")
             .groupBy("number", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("dealt")))

    own = table.select(*(F.col(c).alias(f"_mix_{c}") for c in table.columns))
    named = rows.join(F.broadcast(own), F.col(source).eqNullSafe(F.col("_mix_source"))).withColumn("_mix_of", F.expr("_mix_slice >> _mix_shift"))
    dealt = dealt.withColumnsRenamed({"number": "_mix_d_number", "block": "_mix_d_block", "dealt": "_mix_dealt"})
    joined = named.join(dealt, (F.col("_mix_number") == F.col("_mix_d_number")) & (F.col("_mix_of") == F.col("_mix_d_block")), "left")
    at = F.struct("_mix_draw", F.col(key).alias("key"))
    partial = (F.col("_mix_of") < F.col("_mix_block")) | ((F.col("_mix_of") == F.col("_mix_block")) & F.coalesce(at <= F.col("_mix_stop"), F.lit(False)))
    take = F.filter(F.coalesce("_mix_dealt", F.array().cast("array<struct<pass:int,shard:int>>")), lambda x: (x["pass"] < F.col("_mix_passes")) | partial)
    copies = F.transform(take, lambda x: F.struct(
        x["pass"].alias("pass"), x["shard"].alias("shard"), F.xxhash64(F.lit(seed), x["shard"], x["pass"], F.col("_mix_draw"), F.col(key)).alias("place")))
    return joined.select(*docs.columns, F.col("_mix_size").alias("mix_size"), F.col("_mix_total").alias("mix_source_size"),
                         F.col("_mix_target").alias("mix_target"), copies.alias("mix_copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """A row per copy that the mix takes, with ``mix_shard`` and ``mix_place``; see :func:`planned`."""
    out = planned(docs, **options).drop("mix_size", "mix_source_size", "mix_target")
    kept = [c for c in out.columns if c not in ("mix_copies", "mix_shard", "mix_place")]
    return out.select(*kept, F.explode("mix_copies").alias("_c")).select(*kept, F.col("_c.shard").alias("mix_shard"), F.col("_c.place").alias("mix_place"))
