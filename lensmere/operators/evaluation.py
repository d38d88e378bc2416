"""Retrieval evaluation: sampling, gold ranks, metrics, bootstrap, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lensmere.functions import text as X
from lensmere.operators.running import order_statistics, running_count

# Evaluation defaults.
SEED, ITERATIONS, CUTOFF = 13, 5000, 10
LOW_QUANTILE, HIGH_QUANTILE = 0.025, 0.975


def shuffle_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def sample(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows in the order of a seeded hash; the same rows on every run."""
    return df.orderBy(shuffle_key(F.col(key), seed), key).limit(n)


def eligible_questions(chunks: DataFrame, at_least_words: int = 4) -> DataFrame:
    return chunks.filter(
        (F.col("type") == "QA_pair") & (X.or_empty(F.col("question")) != "")
        & F.col("id").isNotNull() & (X.word_count(F.col("question")) >= at_least_words))


def split_train_dev(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Add ``part``: the first rows of a seeded shuffle are dev, the rest train.

    Ranks are counted within 4096 slices of the hash, so the shuffle order of
    a large table is never sorted in one task.
    """
    hashed = df.withColumn("_h", shuffle_key(F.col(key), seed))
    ranked = running_count(hashed, [], ["_h", key], F.substring("_h", 1, 3), "_place")
    n = df.agg(F.count("*").alias("n")).scalar()
    size = F.when(n > 10_000, F.greatest(F.lit(500), F.floor(n * F.lit(0.01)))).otherwise(
        F.greatest(F.lit(100), F.floor(n * F.lit(0.02))))
    size = F.least(size, F.greatest(F.lit(2000), F.floor(n * F.lit(0.05))))
    return ranked.withColumn("_size", size).withColumn(
        "part", F.when(F.col("_place") <= F.col("_size"), "dev").otherwise("train")
    ).drop("_h", "_place", "_size")


def gold_ranks(gold: DataFrame, runs: DataFrame, conditions: list) -> DataFrame:
    """(condition, query_id, rank): place of the wanted document, 0 if absent.

    ``gold``: (query_id, doc_id); ``runs``: (condition, query_id, doc_id, rank).
    """
    found = runs.join(gold, ["query_id", "doc_id"]).groupBy("condition", "query_id").agg(
        F.min("rank").alias("rank"))
    every = gold.select(
        "query_id", F.explode(F.array(*[F.lit(c) for c in conditions])).alias("condition"))
    return every.join(found, ["condition", "query_id"], "left").select(
        "condition", "query_id", F.coalesce("rank", F.lit(0)).alias("rank"))


def recall_mrr(ranks: DataFrame, k: int = CUTOFF) -> DataFrame:
    """Recall at 1, 5 and k and mean reciprocal rank per condition."""
    r = F.col("rank")

    def recall(at: int) -> Column:
        return F.round(F.avg(F.when((r > 0) & (r <= at), 1.0).otherwise(0.0)), 3)

    return ranks.groupBy("condition").agg(
        F.count("*").alias("n"), recall(1).alias("recall_1"), recall(5).alias("recall_5"),
        recall(k).alias("recall_k"),
        F.round(F.avg(F.when(r > 0, F.lit(1.0) / r).otherwise(0.0)), 3).alias("mrr"))


def paired_hits(ranks: DataFrame, a: str, b: str, k: int = CUTOFF) -> DataFrame:
    """(query_id, hit_a, hit_b) for two conditions."""
    hit = F.when((F.col("rank") > 0) & (F.col("rank") <= k), 1.0).otherwise(0.0)
    return ranks.filter(F.col("condition").isin(a, b)).groupBy("query_id").agg(
        F.max(F.when(F.col("condition") == a, hit)).alias("hit_a"),
        F.max(F.when(F.col("condition") == b, hit)).alias("hit_b"))


def rescue_lost(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count_if((F.col("hit_a") > 0) & (F.col("hit_b") == 0)).alias("rescued"),
        F.count_if((F.col("hit_b") > 0) & (F.col("hit_a") == 0)).alias("lost"))


def bootstrap(pairs: DataFrame, key: str = "query_id", iterations: int = ITERATIONS,
              seed: int = 1) -> DataFrame:
    """Paired bootstrap of mean(hit_a) - mean(hit_b): point, low, high, significant.

    Draw j of iteration i picks the row numbered hash(i, j, seed) mod n.  Rows
    with equal pairs are interchangeable, so draws are joined to their row and
    reduced to one sum per iteration before anything is gathered.  The pairs
    (one row per query) are read three times and therefore kept.
    """
    pairs = pairs.persist()
    n = pairs.agg(F.count("*").alias("n")).scalar()
    numbered = running_count(
        pairs.withColumn("_h", shuffle_key(F.col(key), seed)), [], ["_h", key],
        F.substring("_h", 1, 3), "_no")
    rows = numbered.select(
        (F.col("_no") - 1).alias("at"), (F.col("hit_a") - F.col("hit_b")).alias("diff"))
    draws = rows.select("at", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("i"))
    picked = draws.select("i", F.pmod(X.hash32(F.concat_ws(
        "|", F.col("i").cast("string"), F.col("at").cast("string"), F.lit(str(seed)))), n)
        .alias("at"))
    means = picked.join(rows, "at").groupBy("i").agg(
        F.round(F.avg("diff"), 9).alias("mean"))
    # One number per iteration.
    sorted_means = means.agg(F.array_sort(F.collect_list("mean")).alias("m"))
    point = pairs.agg(F.avg(F.col("hit_a") - F.col("hit_b")).alias("p")).scalar()
    low = F.get("m", F.lit(int(LOW_QUANTILE * iterations)))
    high = F.get("m", F.lit(int(HIGH_QUANTILE * iterations)))
    return sorted_means.select(
        F.round(point, 3).alias("point"), F.round(low, 3).alias("low"),
        F.round(high, 3).alias("high"), ((low > 0) | (high < 0)).alias("significant"))


def latency_summary(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, p95 (an observed value, never interpolated), min and max."""
    stats = order_statistics(df, column, {
        "low_middle": lambda n: F.floor((n - 1) / 2),
        "high_middle": lambda n: F.floor(n / 2),
        "p95": lambda n: F.floor(F.lit(0.95) * (n - 1)),
    }).groupBy().pivot("name", ["low_middle", "high_middle", "p95"]).agg(F.first("value"))
    basics = df.agg(
        F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
    return stats.select(
        F.round(basics.select("mean").scalar(), 2).alias("mean"),
        F.round((F.col("low_middle") + F.col("high_middle")) / 2, 2).alias("median"),
        F.round("p95", 2).alias("p95"),
        F.round(basics.select("min").scalar(), 2).alias("min"),
        F.round(basics.select("max").scalar(), 2).alias("max"))
