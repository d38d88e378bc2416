"""Near-duplicate documents by min-max hashing.

Every hash function is evaluated once per shingle and gives two signature values, its smallest and its
largest, each equal between two sets with a probability of their similarity.  Bands of four values
(two functions) propose pairs; every proposed pair is confirmed on the full sets.

Proposed pairs are never expanded within a large bucket.  Members are first held against the smallest
fingerprint of their bucket; what those links join needs no further test.  In buckets that still hold
more than one component, members meet in blocks inside a task, which returns links only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lensmere.llm import flat, shared

WORDS = 5
PERCENT = 80
FUNCTIONS = 40
VALUES_A_BAND = 4
BLOCK_BYTES = 8 << 20


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(1789))
    top = np.iinfo(np.uint64).max
    return rng.integers(0, top, n, np.uint64) | np.uint64(1), rng.integers(0, top, n, np.uint64)


def signatures(values: np.ndarray, offsets: np.ndarray, functions: int) -> np.ndarray:
    """A row of 2 * functions values per non-empty set: smallest and largest hash of each function."""
    at = offsets[:-1]
    out = np.empty((len(at), 2 * functions), np.uint64)
    for k, (a, b) in enumerate(zip(*_functions(functions))):
        h = values * a + b
        out[:, 2 * k] = np.minimum.reduceat(h, at)
        out[:, 2 * k + 1] = np.maximum.reduceat(h, at)
    return out


def bands(signature: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per band of ``width`` values; the number of the band takes part in it."""
    n = signature.shape[1] // width
    out = np.empty((len(signature), n), np.uint64)
    for j in range(n):
        h = np.full(len(signature), j + 1, np.uint64)
        for k in range(width):
            h = flat.mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, j * width + k])
        out[:, j] = h
    return out


def _print(own: np.ndarray) -> bytes:
    """128 bits that name a set."""
    a = flat.mix(own).sum(dtype=np.uint64) + np.uint64(len(own))
    b = flat.mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return a.astype(">u8").tobytes() + b.astype(">u8").tobytes()


def _sketch(words: int, functions: int, width: int):
    schema = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("print", T.BinaryType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            n, prints, rows = [], [], []
            for _, data, offsets in flat.groups(batch.column("text")):
                values, own = flat.shingles(data, offsets, words)
                sizes = np.diff(own)
                full = np.flatnonzero(sizes)
                n.append(sizes)
                got = [None] * len(sizes)
                hashed = [None] * len(sizes)
                if len(full):
                    b = bands(signatures(values, np.append(own[full], own[-1]), functions), width).view(np.int64)
                    for i, row in zip(full, b):
                        got[i], hashed[i] = _print(values[own[i]:own[i + 1]]), row
                prints += got
                rows += hashed
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64()),
                 pa.array(prints, pa.binary()), pa.array(rows, pa.list_(pa.int64()))],
                names=["key", "n_shingles", "print", "bands"])

    return run, schema


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for _, data, offsets in flat.groups(batch.column("text")):
                values, own = flat.shingles(data, offsets, words)
                sets = [values[own[i]:own[i + 1]] for i in range(len(own) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array([_print(x) for x in sets], pa.binary()),
                                                  pa.array([x.tobytes() for x in sets], pa.binary())], names=["print", "set"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _star_links(percent: int):
    def run(batches):
        for batch in batches:
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(batch.column("set").to_pylist(), batch.column("lead_set").to_pylist())]
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column("print").take(at), batch.column("lead").take(at)], names=["a", "b"])

    return run


def _block_links(percent: int):
    """Links between members of different components in one pair of blocks of one bucket."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        roots = table.column("root").to_pylist()
        sides = table.column("side").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        if key[1].as_py() == key[2].as_py():
            sides = np.zeros(len(sets), sides.dtype)
            pairs_within = True
        else:
            pairs_within = False
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        flat_values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat_values, kind="stable")
        owner, ordered = owner[order], flat_values[order]
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(ordered)))
        place = np.empty(len(ordered), np.int64)
        place[order] = np.repeat(np.arange(len(starts)), lengths)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        at_root = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        root = np.array([at_root[r] for r in roots])
        merged = list(range(len(at_root)))

        def find(x):
            while merged[x] != x:
                merged[x] = merged[merged[x]]
                x = merged[x]
            return x

        a, b = [], []
        for i in range(len(sets)):
            if not pairs_within and sides[i]:
                continue
            own = place[bounds[i]:bounds[i + 1]]
            n = lengths[own]
            near = owner[np.repeat(starts[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            common = np.bincount(near, minlength=len(sets))
            good = 100 * common >= percent * (sizes + sizes[i] - common)
            good &= root != root[i]
            good &= np.arange(len(sets)) > i if pairs_within else sides == 1
            for j in np.flatnonzero(good):
                x, y = find(root[i]), find(root[j])
                if x != y:
                    merged[x] = y
                    a.append(roots[i])
                    b.append(roots[j])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    percent: int = PERCENT, functions: int = FUNCTIONS, width: int = VALUES_A_BAND,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_shingles, component, kept) for every row.

    Two texts are linked if ``100 * common >= percent * together`` holds for their sets of distinct
    ``words``-word shingles (A-Z lower-cased; a text with fewer words is one shingle).  ``component``
    is the smallest key that links reach, ``kept`` says that it is the row's own key.

    A null text or one without words has no shingles and is linked with nothing.  Equal sets are
    linked, so repeated rows share a component.  A null key never becomes a component while another
    member has a key; alone it keeps a null component and is kept.  Rows that repeat a key are each
    judged by their own text.  An empty table gives an empty result.  Other columns are not read.

    At a similarity of 0.85 a pair shares no band with a probability of (1 - 0.85**4)**20 = 4e-7.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    run, extra = _sketch(words, functions, width)
    sketch = shared.staged(rows.mapInArrow(shared.tidy(run), T.StructType([rows.schema["key"], *extra])))

    members = sketch.where("print is not null").select("print", F.explode("bands").alias("band")).distinct()
    leads = members.groupBy("band").agg(F.min("print").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    full = shared.staged(members.join(leads, "band"))

    wanted = full.select("print").distinct()
    keys = (sketch.select("print", "key").join(wanted, "print", "left_semi")
            .groupBy("print").agg(F.min("key").alias("key")).select(F.col("key").alias("wanted_key")).distinct())
    sets = shared.staged(
        rows.join(keys, F.col("key").eqNullSafe(F.col("wanted_key"))).select("text")
        .mapInArrow(shared.tidy(_sets(words)), "print binary, set binary")
        .join(wanted, "print", "left_semi").dropDuplicates(["print"]))

    pairs = full.where("print <> lead").select("print", "lead").distinct()
    lead_sets = sets.select(F.col("print").alias("lead"), F.col("set").alias("lead_set"))
    star = (pairs.join(sets, "print").join(lead_sets, "lead").select("print", "lead", "set", "lead_set")
            .mapInArrow(shared.tidy(_star_links(percent)), "a binary, b binary"))
    first = shared.staged(shared.components(star))

    # The first member of a bucket has met all others.  Those are still open where they are of several
    # components; a set of members that several buckets share is dealt with in one of them.
    rooted = full.where("print <> lead").join(first.withColumnRenamed("node", "print"), "print", "left").select(
        "band", "print", F.coalesce("root", "print").alias("root"))
    open_bands = (rooted.groupBy("band").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"),
        F.sum(F.xxhash64("print").cast("decimal(38,0)")).alias("mark"), F.sum(F.xxhash64(F.lit(1), "print").cast("decimal(38,0)")).alias("mark2"))
        .where("low <> high").groupBy("members", "mark", "mark2").agg(F.min("band").alias("band")).select("band"))
    sized = shared.staged(rooted.join(shared.staged(open_bands), "band")).join(sets, "print").select("band", "print", "root", "set")
    open_bands = (sized.groupBy("band").agg(F.sum(F.length("set")).alias("bytes"))
                  .select("band", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("n")))
    block = F.pmod(F.xxhash64("print"), F.col("n")).cast("int")
    dealt = (sized.join(open_bands, "band")
             .select("band", "print", "root", "set", block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
             .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "print", "root", "set"))
    rest = dealt.groupBy("band", "i", "j").applyInArrow(_block_links(percent), "a binary, b binary")
    second = shared.components(rest).select(F.col("node").alias("root"), F.col("root").alias("last"))

    joined = (first.join(second, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
              .union(second.join(first.select(F.col("node").alias("root")), "root", "left_anti").select("root", "last")))
    labelled = (sketch.select("key", "n_shingles", "print")
                .join(joined.withColumnRenamed("node", "print"), "print", "left")
                .select("key", "n_shingles", F.coalesce("root", "print").alias("root")))
    lowest = shared.staged(labelled.where("root is not null").groupBy("root").agg(F.min("key").alias("component")))  # so that a large component is split in the join
    return (labelled.join(lowest, "root", "left")
            .select(F.col("key").alias(key), "n_shingles",
                    F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"))
            .withColumn("kept", F.col(key).eqNullSafe(F.col("component"))))
