"""Keyword evaluation of dense and hybrid search over a chunk table.

    spark-submit -m lensmere.jobs.evaluate --input CHUNKS --output FOLDER [--n 500 -k 10 --seed 13]

Questions of QA chunks become keyword queries; the chunk they come from is the
wanted one.  Writes recall and reciprocal rank per condition, what hybrid
search rescues and loses, and a bootstrap interval of the difference.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from lensmere.functions import text as X
from lensmere.operators import evaluation, experiment, models
from lensmere.session import ship
from lensmere.sources import writers


def main(argv: list | None = None) -> None:
    p = argparse.ArgumentParser(prog="lensmere.jobs.evaluate")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--n", type=int, default=500)
    p.add_argument("-k", type=int, default=evaluation.CUTOFF)
    p.add_argument("--seed", type=int, default=evaluation.SEED)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lensmere-evaluate").getOrCreate()
    ship(spark)
    chunks = spark.read.parquet(a.input)
    picked = evaluation.sample(evaluation.eligible_questions(chunks), "id", a.n, a.seed)
    queries = picked.select(F.col("id").alias("query_id"),
                            X.keyword_query(F.col("question")).alias("text"))
    gold = picked.select(F.col("id").alias("query_id"), F.col("id").alias("doc_id"))
    docs = chunks.select(F.col("id").alias("doc_id"), "text")
    experiment.gold_ranks(
        queries, gold, docs, models.hashing_embedder(), models.overlap_reranker, a.k,
    ).write.mode("overwrite").parquet(f"{a.output}/ranks")
    # The reports read the written ranks, so every search runs once.
    ranks = spark.read.parquet(f"{a.output}/ranks")
    pairs = evaluation.paired_hits(ranks, "hybrid_raw", "dense_raw", a.k)
    writers.report(evaluation.recall_mrr(ranks, a.k), f"{a.output}/metrics")
    writers.report(evaluation.rescue_lost(pairs), f"{a.output}/rescue")
    writers.report(evaluation.bootstrap(pairs), f"{a.output}/gap")


if __name__ == "__main__":
    main()
