"""Near-duplicate vectors by product quantisation.

A coarse codebook deals the vectors into inverted lists; the residual of a vector is kept as one code
per subspace.  Every vector probes the lists of its nearest centroids.  In a list, distances to the
codes come from per-probe lookup tables; since the distance between a vector and its code is stored,
the triangle inequality rejects only pairs that cannot reach the threshold.  The rest is held against
the threshold by exact cosine.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from lensmere.llm import shared

COSINE = 0.9
PROBES = 8
SUBSPACES = 8
CODEWORDS = 256
#: Rows the codebooks are fitted on (those with the smallest hashes); every row is indexed.
SAMPLE = 16_384
#: Largest number of coarse lists, which bounds the broadcast codebook; larger lists meet in blocks.
MOST_LISTS = 4_096
BLOCK_ROWS = 4_096


def _nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    gap = (centres ** 2).sum(1) - 2 * (x @ centres.T)
    if n == 1:
        return gap.argmin(1)[:, None]
    top = np.argpartition(gap, n - 1, axis=1)[:, :n] if n < gap.shape[1] else np.tile(np.arange(gap.shape[1]), (len(x), 1))
    return np.take_along_axis(top, np.argsort(np.take_along_axis(gap, top, 1), 1, "stable"), 1)


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)[:, 0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


class Codebooks:
    """Coarse centroids and the codewords of each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codewords: int) -> None:
        rng = np.random.Generator(np.random.PCG64(7))
        self.coarse = _k_means(sample, lists, 6, rng)
        rest = sample - self.coarse[_nearest(sample, self.coarse)[:, 0]]
        self.cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        self.words = [_k_means(rest[:, a:b], codewords, 6, rng) for a, b in zip(self.cuts[:-1], self.cuts[1:])]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance between each vector and what its code stands for)."""
        rest = x - self.coarse[lists]
        codes = np.empty((len(x), len(self.words)), np.uint8)
        error = np.zeros(len(x))
        for m, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            codes[:, m] = _nearest(rest[:, a:b], self.words[m])[:, 0]
            error += ((rest[:, a:b] - self.words[m][codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def distances(self, x: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances between whole vectors and the codes of one list, by table lookup."""
        rest = x - self.coarse[of]
        out = np.zeros((len(x), len(codes)))
        for m, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            part, words = rest[:, a:b], self.words[m]
            table = (part ** 2).sum(1)[:, None] + (words ** 2).sum(1) - 2 * (part @ words.T)
            out += table[:, codes[:, m]]
        return out


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    """Packed doubles as a matrix; a shorter vector is continued by zeros."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        v = np.frombuffer(r, np.float64)
        out[i, :len(v)] = v
    return out


def packed(column) -> list[bytes | None]:
    """Packed doubles of an Arrow list column; None where a vector or component is null, or not finite."""
    out = []
    for v in column.to_pylist():
        good = v is not None and len(v) > 0 and None not in v
        x = np.array(v, np.float64) if good else None
        out.append(x.tobytes() if good and np.isfinite(x).all() else None)
    return out


def _pack(batches):
    for batch in batches:
        rows = packed(batch.column("v"))
        usable = [r is not None and np.frombuffer(r).any() for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array([r if u else None for r, u in zip(rows, usable)], pa.binary())], names=["key", "vec"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _index(books, width: int, probes: int):
    def run(batches):
        own = books.value
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            if not vecs:
                continue
            x = _unit(unpacked(vecs, width))
            near = _nearest(x, own.coarse, min(probes, len(own.coarse)))
            codes, error = own.encode(x, near[:, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec"), batch.column("copies"), pa.array(near[:, 0], pa.int32()), pa.array(list(near), pa.list_(pa.int32())),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                names=["vec", "copies", "list", "probes", "code", "error"])

    return run


def _meet(books, width: int, cosine: float):
    """One block of a list against one block of its probes: links of each vector, and links that join."""
    reach = math.sqrt(2 - 2 * cosine) + 1e-6

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        book, of = books.value, key[0].as_py()
        stored = table.filter(pa.compute.equal(table.column("side"), 0))
        asking = table.filter(pa.compute.equal(table.column("side"), 1))
        names_s, names_q = stored.column("vec").to_pylist(), asking.column("vec").to_pylist()
        out_names, counts = [], []
        a, b = [], []
        if names_s and names_q:
            raw_s, raw_q = unpacked(names_s, width), unpacked(names_q, width)
            s, q = _unit(raw_s), _unit(raw_q)
            codes = np.frombuffer(b"".join(stored.column("code").to_pylist()), np.uint8).reshape(len(s), -1)
            limit = (reach + stored.column("error").to_numpy()) ** 2
            copies_s, copies_q = stored.column("copies").to_numpy(), asking.column("copies").to_numpy()
            # Does the stored vector also ask the list where the asking one is stored?
            probes = stored.column("probes").combine_chunks()
            ask = np.repeat(np.arange(len(s)), np.diff(probes.offsets.to_numpy()))
            there = set(zip(ask.tolist(), probes.flatten().to_pylist()))
            home = asking.column("list").to_pylist()
            place = {n: i for i, n in enumerate(names_s)}
            merged = list(range(len(s) + len(q)))

            def find(x):
                while merged[x] != x:
                    merged[x] = merged[merged[x]]
                    x = merged[x]
                return x

            n_s, n_q = np.zeros(len(s), np.int64), np.zeros(len(q), np.int64)
            twin = np.array([place.get(n, -1) for n in names_q])
            for at in range(0, len(q), 256):
                i, j = np.nonzero(book.distances(q[at:at + 256], of, codes) <= limit)
                i += at
                other = twin[i] != j
                i, j = i[other], j[other]
                for part in range(0, len(i), 1 << 18):
                    x, y = i[part:part + (1 << 18)], j[part:part + (1 << 18)]
                    good = np.einsum("ij,ij->i", q[x], s[y]) >= cosine - 1e-9
                    x, y = x[good], y[good]
                    exact = np.einsum("ij,ij->i", raw_q[x], raw_s[y]) / (np.linalg.norm(raw_q[x], axis=1) * np.linalg.norm(raw_s[y], axis=1))
                    good = exact >= cosine
                    x, y = x[good], y[good]
                    if not len(x):
                        continue
                    n_q += np.bincount(x, copies_s[y], len(q)).astype(np.int64)
                    single = np.array([(v, home[u]) not in there for u, v in zip(x.tolist(), y.tolist())], bool)
                    n_s += np.bincount(y[single], copies_q[x[single]], len(s)).astype(np.int64)
                    for u, v in zip(x.tolist(), y.tolist()):
                        c, d = find(u), find(len(q) + v)
                        if c != d:
                            merged[c] = d
                            a.append(names_q[u])
                            b.append(names_s[v])
            for names, n in ((names_s, n_s), (names_q, n_q)):
                hit = np.flatnonzero(n)
                out_names += [names[h] for h in hit]
                counts += n[hit].tolist()
        m, k = len(out_names), len(a)
        return pa.table({"vec": pa.array(out_names + a, pa.binary()), "n": pa.array(counts + [None] * k, pa.int64()),
                         "other": pa.array([None] * m + b, pa.binary())})

    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE,
                 probes: int = PROBES, lists: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(key, n_links, component, kept) for every row.

    Two vectors are linked if their cosine in double precision is ``cosine`` or more.  ``n_links`` counts
    the other rows linked directly, ``component`` is the smallest key that links reach.

    A vector that is null, empty, zero or holds a null or non-finite component is linked with nothing.
    Of vectors of unequal length the shorter one is continued by zeros.  Equal vectors are compared once
    and count with all their copies.  A null key never becomes a component while another member has a
    key.  An empty table gives an empty result.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    keyed = shared.staged(rows.mapInArrow(_pack, f"key {rows.schema['key'].dataType.simpleString()}, vec binary"))
    distinct = shared.staged(keyed.where("vec is not null").groupBy("vec").agg(F.count("*").alias("copies")))
    n, width = distinct.agg(F.count("*"), F.max(F.length("vec"))).first()
    width = (width or 8) // 8
    fitted = [r.vec for r in distinct.orderBy(F.xxhash64("vec")).limit(sample).select("vec").collect()]
    if not fitted:
        return keyed.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"),
                            F.lit(True).alias("kept"))
    lists = lists or min(MOST_LISTS, math.ceil(2 * math.sqrt(n)))
    books = spark.sparkContext.broadcast(Codebooks(_unit(unpacked(fitted, width)), min(lists, len(fitted)), SUBSPACES, CODEWORDS))
    index = shared.staged(distinct.mapInArrow(
        _index(books, width, probes), "vec binary, copies long, list int, probes array<int>, code binary, error double"))

    asked = index.select("*", F.explode("probes").alias("of"))
    stored_blocks = index.groupBy(F.col("list").alias("of")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n_s"))
    asking_blocks = asked.groupBy("of").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n_q"))
    blocks = F.broadcast(stored_blocks.join(asking_blocks, "of"))  # a row per list: at most MOST_LISTS
    stored = index.withColumn("of", F.col("list")).join(blocks, "of").select(
        "of", F.pmod(F.xxhash64("vec"), "n_s").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_q").cast("long") - 1)).alias("j"),
        F.lit(0).alias("side"), "vec", "copies", "list", "probes", "code", "error")
    asking = asked.join(blocks, "of").select(
        "of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_s").cast("long") - 1)).alias("i"), F.pmod(F.xxhash64("vec"), "n_q").alias("j"),
        F.lit(1).alias("side"), "vec", "copies", "list", F.lit(None).cast("array<int>").alias("probes"),
        F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"))
    met = shared.staged(stored.union(asking).groupBy("of", "i", "j").applyInArrow(_meet(books, width, cosine), "vec binary, n long, other binary"))
    roots = shared.components(met.where("other is not null").select(F.col("vec").alias("a"), F.col("other").alias("b")))
    links = met.where("n is not null").groupBy("vec").agg(F.sum("n").alias("n"))

    named = (keyed.join(distinct, "vec", "left").join(links, "vec", "left").join(roots.withColumnRenamed("node", "vec"), "vec", "left")
             .select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
                     F.coalesce("root", "vec").alias("root")))
    lowest = shared.staged(named.where("root is not null").groupBy("root").agg(F.min("key").alias("component")))  # so that a large component is split in the join
    return (named.join(lowest, "root", "left")
            .select(F.col("key").alias(key), "n_links",
                    F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"))
            .withColumn("kept", F.col(key).eqNullSafe(F.col("component"))))
