"""Summary tree: clusters of vectors, representatives, nodes, overview search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from lensmere.functions import text as X
from lensmere.functions import vectors as V
from lensmere.operators import dense
from lensmere.operators.evidence import overview_hits
from lensmere.operators.models import Embedder, extractive_summary

# Tree parameters.
ITERATIONS, CLUSTER_SEED, SMALLEST = 15, 42, 3
REPRESENTATIVES, TEXT_CHARS, KEY_CHARS, REPRESENTATIVE_CHARS = 8, 200, 80, 300
OVERVIEW_K, OVERVIEW_MIN = 2, 0.35


#: Sums that a task holds before it passes them on.
SUM_VALUES = 8 << 20
#: Parts in which the tasks' sums of a cluster are put together before the last step.
SUM_PARTS = 64


def _sums(batches):
    """(cluster, n, s): members and their vector sum, per task."""
    held: dict = {}
    size = 0

    def out(held):
        return pa.RecordBatch.from_arrays([
            pa.array(list(held), kind), pa.array([n for n, _ in held.values()], pa.int64()),
            pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.float64()))], ["cluster", "n", "s"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field("cluster").type
        x = dense._matrix(batch.column("embedding"))
        coded = batch.column("cluster").dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))
        for c, total, n in zip(coded.dictionary.take(pa.array(code[order][first])).to_pylist(),
                               np.add.reduceat(x[order], first), np.diff(np.append(first, len(order)))):
            have = held.get(c)
            size += 0 if have else len(total)
            held[c] = (int(n), total) if have is None else (have[0] + int(n), have[1] + total)
        if size > SUM_VALUES:
            yield out(held)
            held, size = {}, 0
    if held:
        yield out(held)


def means(members: DataFrame) -> DataFrame:
    """(cluster, n, embedding): mean vector of each cluster.

    Tasks pass on one sum per cluster they met; these are put together in parts
    first, so no task adds up what all others found for one cluster.
    """
    kind = members.schema["cluster"].dataType.simpleString()
    rows = members.select("cluster", V.as_double(F.col("embedding")).alias("embedding")).filter(F.col("embedding").isNotNull())
    partial = rows.mapInArrow(_sums, f"cluster {kind}, n bigint, s array<double>")
    total = F.aggregate(F.collect_list("s"), F.array().cast("array<double>"), lambda a, x: F.when(
        F.size(a) == 0, x).otherwise(F.zip_with(a, x, lambda p, q: p + q)))
    some = partial.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(SUM_PARTS))).groupBy("cluster", "_part").agg(
        F.sum("n").alias("n"), total.alias("s"))
    whole = some.groupBy("cluster").agg(F.sum("n").alias("n"), total.alias("s"))
    return whole.select("cluster", "n", F.transform("s", lambda x: x / F.col("n")).alias("embedding"))


def centroids(members: DataFrame, normalise: bool = True) -> DataFrame:
    """(cluster, embedding): mean of the members, of unit length if asked."""
    vector = means(members).select("cluster", "embedding")
    return vector.withColumn(
        "embedding", V.normalised(F.col("embedding"))) if normalise else vector


def _nearer(shared, ids_type):
    """Lower (distance, cluster) of what a row has and the nearest centre of one block."""
    def run(batches):
        ids, matrix = shared.value
        lengths = (matrix * matrix).sum(axis=1)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = dense._matrix(batch.column("embedding"))
            own = np.zeros(len(x), np.int64)
            found = np.full(len(x), np.inf)
            step = max(1, dense.BLOCK_ENTRIES // max(1, len(matrix)))
            for at in range(0, len(x), step):
                part = x[at:at + step]
                d = np.round((part * part).sum(axis=1)[:, None] - 2 * part @ matrix.T + lengths, 6)
                own[at:at + step] = d.argmin(axis=1)
                found[at:at + step] = d[np.arange(len(d)), own[at:at + step]]
            before = batch.column("distance").fill_null(float("inf")).to_numpy(zero_copy_only=False)
            closer = found < before  # blocks come in the order of their ids, so ties stay with the lower
            cluster = pc.if_else(pa.array(closer), pa.array(ids[own], ids_type), batch.column("cluster"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("embedding"), cluster, pa.array(np.where(closer, found, before))],
                ["doc_id", "embedding", "cluster", "distance"])

    return run


def assign(vectors: DataFrame, centres: DataFrame,
           broadcast_bytes: int = dense.BROADCAST_BYTES) -> DataFrame:
    """(doc_id, cluster, distance): nearest centre (least squared distance, ties to the lower id).

    Centres travel in blocks of at most about ``broadcast_bytes``, in the order
    of their ids; vectors are read once and carry the best centre so far from
    block to block.
    """
    return _assigned(vectors, centres, broadcast_bytes).drop("embedding")


def _assigned(vectors: DataFrame, centres: DataFrame, broadcast_bytes: int) -> DataFrame:
    kind = centres.schema["cluster"].dataType
    rows = vectors.select("doc_id", V.as_double(F.col("embedding")).alias("embedding"),
                          F.lit(None).cast(kind).alias("cluster"), F.lit(None).cast("double").alias("distance"))
    sample, most = dense.bounded_table(centres, broadcast_bytes)
    blocks = [sample] if sample is not None else None
    if blocks is None:  # cut points by id, one block at a time on the driver
        count = -(-centres.count() // most)
        cuts = centres.select(F.percentile_approx("cluster", [i / count for i in range(1, count)], 10_000)).first()[0] if count > 1 else []
        edges_ = [None, *sorted(set(cuts)), None]
        blocks = []
        for low, high in zip(edges_, edges_[1:]):
            part = centres
            part = part if low is None else part.filter(F.col("cluster") > low)
            part = part if high is None else part.filter(F.col("cluster") <= high)
            blocks.append(part.toArrow())
    context = vectors.sparkSession.sparkContext
    for block in blocks:
        if not block.num_rows:
            continue
        block = block.sort_by("cluster")
        shared = context.broadcast((block["cluster"].to_numpy(), dense._matrix(block["embedding"])))
        rows = rows.mapInArrow(_nearer(shared, block["cluster"].type), rows.schema)
    return rows


def first_centres(vectors: DataFrame, k: int) -> DataFrame:
    """(cluster, embedding): the k vectors whose ids have the least hashes, whatever the order of the table."""
    mark = F.md5(F.col("doc_id").cast("string"))
    chosen = vectors.filter(F.col("embedding").isNotNull()).select(
        "doc_id", V.as_double(F.col("embedding")).alias("embedding"), mark.alias("_m")).orderBy("_m", "doc_id").limit(k)
    place = W.orderBy("_m", "doc_id")  # k rows
    return chosen.withColumn("cluster", F.row_number().over(place) - 1).select("cluster", "embedding")


def lloyd(vectors: DataFrame, k: int, folder: str, iterations: int = ITERATIONS,
          broadcast_bytes: int = dense.BROADCAST_BYTES) -> DataFrame:
    """(doc_id, embedding, cluster) after so many rounds of nearest centres and their means.

    Every round reads the vectors once, in Arrow batches, and leaves one sum
    per task and cluster; its centres are written below ``folder``, so a lost
    executor repeats a round and not those before it.  A centre that nobody is
    nearest to stays where it is.
    """
    spark = vectors.sparkSession
    vectors = vectors.filter(F.col("embedding").isNotNull()).select("doc_id", V.as_double(F.col("embedding")).alias("embedding"))
    first_centres(vectors, k).write.mode("overwrite").parquet(f"{folder}/centres/round=0")
    for n in range(iterations):
        centres = spark.read.parquet(f"{folder}/centres/round={n}")
        found = means(_assigned(vectors, centres, broadcast_bytes)).select("cluster", F.col("embedding").alias("_new"))
        centres.join(found, "cluster", "left").select(
            "cluster", F.coalesce("_new", "embedding").alias("embedding")).write.mode("overwrite").parquet(f"{folder}/centres/round={n + 1}")
    return _assigned(vectors, spark.read.parquet(f"{folder}/centres/round={iterations}"), broadcast_bytes).drop("distance")


def kmeans(vectors: DataFrame, k: int, iterations: int = ITERATIONS,
           seed: int = CLUSTER_SEED) -> DataFrame:
    """(doc_id, embedding, cluster) by Spark ML's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = vectors.withColumn("features", array_to_vector(V.as_double(F.col("embedding"))))
    model = KMeans(k=k, maxIter=iterations, seed=seed, predictionCol="cluster").fit(features)
    return model.transform(features).drop("features")


def cluster_sizes(members: DataFrame, done: DataFrame | None = None, smallest: int = SMALLEST,
                  cap: int | None = None) -> DataFrame:
    """Clusters still to summarise, largest first; the cap is an explicit limit per run."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size")).filter(
        F.col("size") >= smallest)
    if done is not None:
        sizes = sizes.join(done.select("cluster"), "cluster", "left_anti")
    ordered = sizes.orderBy(F.col("size").desc(), "cluster")
    return ordered.limit(cap) if cap else ordered


def representatives(members: DataFrame, texts: DataFrame,
                    n: int = REPRESENTATIVES) -> DataFrame:
    """(cluster, place, text): up to n distinct texts nearest the centroid.

    ``members``: (doc_id, cluster, embedding); ``texts``: (doc_id, question, text).
    Texts are joined only for the 2n nearest members of a cluster.
    """
    centre = centroids(members).withColumnRenamed("embedding", "centre")
    scored = members.join(centre, "cluster").select(
        "cluster", "doc_id", F.round(V.dot(F.col("embedding"), F.col("centre")), 6).alias("sim"))
    order = W.partitionBy("cluster").orderBy(F.col("sim").desc(), "doc_id")
    nearest = scored.withColumn("near", F.row_number().over(order)).filter(F.col("near") <= 2 * n)
    question = X.non_empty(X.trimmed(X.or_empty(F.col("question"))))
    shown = F.coalesce(question, F.substring(X.or_empty(F.col("text")), 1, TEXT_CHARS))
    named = nearest.join(texts.select("doc_id", shown.alias("t")), "doc_id").filter("t <> ''")
    once = W.partitionBy("cluster", "_k").orderBy("near")
    unique = named.withColumn("_k", F.substring(F.lower("t"), 1, KEY_CHARS)).withColumn(
        "_n", F.row_number().over(once)).filter("_n = 1")
    place = W.partitionBy("cluster").orderBy("near")
    return unique.withColumn("place", F.row_number().over(place)).filter(
        F.col("place") <= n).select(
        "cluster", "place", F.substring("t", 1, REPRESENTATIVE_CHARS).alias("text"))


def first_members(members: DataFrame, texts: DataFrame, n: int = REPRESENTATIVES) -> DataFrame:
    """(cluster, place, text): the first n members by id, as used for upper levels."""
    place = W.partitionBy("cluster").orderBy("doc_id")
    first = members.select("cluster", "doc_id").withColumn(
        "place", F.row_number().over(place)).filter(F.col("place") <= n)
    return first.join(texts, "doc_id").select(
        "cluster", "place", F.substring("text", 1, REPRESENTATIVE_CHARS).alias("text"))


def nodes(sizes: DataFrame, reps: DataFrame, kind: str, summarise=extractive_summary) -> DataFrame:
    """(id, level, title, text, size): one summary node per cluster."""
    # At most n representative texts per cluster are gathered.
    gathered = reps.groupBy("cluster").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"])
        .alias("texts"))
    summary = sizes.join(gathered, "cluster").withColumn("_s", summarise(F.col("texts")))
    return summary.select(
        F.concat(F.lit(f"{kind}_"), F.col("cluster").cast("string")).alias("id"),
        F.lit(1 if kind == "topic" else 2).alias("level"),
        X.summary_title(F.col("_s")).alias("title"), X.summary_body(F.col("_s")).alias("text"),
        "size")


def enough_for_domains(level_one: DataFrame, domains: int) -> bool:
    """An upper level needs at least two nodes per domain."""
    return level_one.limit(2 * domains).count() >= 2 * domains


def levels(vectors: DataFrame, texts: DataFrame, embedder: Embedder, topics: int, domains: int, folder: str,
           iterations: int = ITERATIONS, summarise=extractive_summary) -> DataFrame:
    """Nodes of both levels: topics of the vectors, domains of the topics' own texts.

    ``vectors``: (doc_id, embedding); ``texts``: (doc_id, question, text).  The
    upper level is left out where there are fewer than two topics per domain.
    """
    spark = vectors.sparkSession
    members = lloyd(vectors, topics, f"{folder}/topics", iterations)
    members.write.mode("overwrite").parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")
    nodes(cluster_sizes(members), representatives(members, texts), "topic", summarise).write.mode(
        "overwrite").parquet(f"{folder}/nodes/one")
    one = spark.read.parquet(f"{folder}/nodes/one")
    if not domains or not enough_for_domains(one, domains):
        return one
    leaf = one.select(F.col("id").alias("doc_id"), X.or_empty(F.col("text")).alias("text")).withColumn("embedding", embedder(F.col("text")))
    upper = lloyd(leaf, domains, f"{folder}/domains", iterations)
    two = nodes(cluster_sizes(upper), first_members(upper, leaf.select("doc_id", "text")), "domain", summarise)
    return one.unionByName(two)


def embedded_nodes(all_nodes: DataFrame, embedder: Embedder) -> DataFrame:
    """Nodes with text, embedded as title and text."""
    return all_nodes.filter(X.or_empty(F.col("text")) != "").withColumn(
        "embedding", embedder(F.concat(X.or_empty(F.col("title")), F.lit(". "), "text")))


def overview(queries: DataFrame, embedded: DataFrame, embedder: Embedder, k: int = OVERVIEW_K,
             min_score: float = OVERVIEW_MIN) -> DataFrame:
    """Best nodes per query as overview passages."""
    hits = dense.search(
        queries.select("query_id", embedder(F.col("text")).alias("embedding")),
        embedded.select(F.col("id").alias("doc_id"), "embedding"), k, min_score)
    shown = hits.join(embedded.select(F.col("id").alias("doc_id"), "title", "text", "level"),
                      "doc_id")
    return overview_hits(shown)
