"""Batch jobs over files and tables.

    spark-submit -m lensmere.jobs.build <job> [options]

Jobs: chunk, index, lexical, shrink, tree, finalize, contexts, reembed, concepts.
Every job reads and writes tables, so it can be run again after a failure.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from lensmere.operators import chunking, corpus, dense, evaluation, inverted, models, tree, vectorstore
from lensmere.session import ship
from lensmere.sources import readers, writers
from lensmere.tables import exists


def chunk(spark, a) -> None:
    """QA directory to a chunk table with running ids."""
    docs = readers.read_qa_directory(spark, a.input, a.source, a.url_prefix)
    keyed = docs.withColumn("doc_id", F.xxhash64("category", "file", "question"))
    chunking.chunk_documents(keyed, a.budget, a.overlap).write.mode("overwrite").parquet(
        f"{a.output}/unnumbered")
    # Numbered from the written table, so no document is chunked twice.
    written = spark.read.parquet(f"{a.output}/unnumbered")
    block = F.shiftright("doc_id", 48)
    writers.write_chunks(chunking.number_chunks(written, a.prefix, 6, block),
                         f"{a.output}/chunks", "overwrite")


def index(spark, a) -> None:
    """Chunk table to a vector index; with --append only new ids are embedded."""
    chunks = spark.read.parquet(a.input).select("id", "text")
    embed = models.hashing_embedder(a.dim)
    if a.append:
        have = spark.read.parquet(f"{a.output}/vectors")
        fresh = corpus.new_rows(chunks, have).select("id", embed(F.col("text")).alias("embedding"))
        writers.write_vector_index(fresh, a.output, f"hashing-{a.dim}", "append")
    else:
        writers.write_vector_index(
            chunks.select("id", embed(F.col("text")).alias("embedding")), a.output, f"hashing-{a.dim}")


def lexical_index(spark, a) -> None:
    """Chunk table to a BM25 index; an index that is there is brought up to the chunks, bucket by bucket."""
    docs = spark.read.parquet(a.input).select(F.col("id").alias("doc_id"), "text")
    if a.force:
        inverted.build(docs, a.output)
    else:
        done = inverted.refresh(docs, a.output)
        print(f"changed rows: {done['rows']}, buckets written: {done['buckets']}")


def shrink(spark, a) -> None:
    """8-bit codes for a vector index, checked against exact search."""
    v = spark.read.parquet(f"{a.input}/vectors").withColumnRenamed("id", "doc_id")
    ranges = dense.dimension_ranges(v)
    ranges.write.mode("overwrite").parquet(f"{a.output}/ranges")
    stored = spark.read.parquet(f"{a.output}/ranges")
    dense.encode(v, stored).write.mode("overwrite").parquet(f"{a.output}/codes")
    writers.describe_codes(spark, a.input, a.output)
    decoded = dense.decode(spark.read.parquet(f"{a.output}/codes"), stored)
    asked = evaluation.sample(v, "doc_id", a.sample, 0).withColumnRenamed("doc_id", "query_id")
    exact, near = dense.search(asked, v, a.k), dense.search(asked, decoded, a.k)
    recall = dense.neighbour_overlap(exact, near, a.k).agg(F.avg("overlap")).first()[0]
    print(f"recall@{a.k}: {recall:.4f}")
    if a.apply:
        writers.swap_index(spark, recall, a.min_recall, a.input, a.output, f"{a.input}.kept")


def summary_tree(spark, a) -> None:
    """Topics (and domains) of a chunk table as summary nodes."""
    chunks = spark.read.parquet(a.input).select(
        F.col("id").alias("doc_id"), "text", F.col("question"))
    vectors = spark.read.parquet(f"{a.vectors}/vectors").withColumnRenamed("id", "doc_id")
    tree.lloyd(vectors, a.topics, f"{a.output}/rounds/topics").write.mode("overwrite").parquet(f"{a.output}/topics")
    members = spark.read.parquet(f"{a.output}/topics")
    sizes = tree.cluster_sizes(members, cap=a.cap or None)
    tree.nodes(sizes, tree.representatives(members, chunks), "topic").write.mode(
        "overwrite").parquet(f"{a.output}/nodes/level=1")
    topics = spark.read.parquet(f"{a.output}/nodes/level=1")
    if a.domains and tree.enough_for_domains(topics, a.domains):
        embed = models.hashing_embedder()
        leaf = topics.select(F.col("id").alias("doc_id"), "text", embed(F.col("text")).alias("embedding"))
        grouped = tree.lloyd(leaf, a.domains, f"{a.output}/rounds/domains")
        tree.nodes(tree.cluster_sizes(grouped), tree.first_members(grouped, leaf.select("doc_id", "text")),
                   "domain").write.mode("overwrite").parquet(f"{a.output}/nodes/level=2")
    finalize(spark, a)


def finalize(spark, a) -> None:
    """The nodes of a tree, of whatever levels are there, as a vector index beside them."""
    nodes = spark.read.parquet(f"{a.output}/nodes")
    embedded = tree.embedded_nodes(nodes, models.hashing_embedder(a.dim))
    writers.write_vector_index(embedded.select("id", "embedding"), f"{a.output}/index", f"hashing-{a.dim}")


def contexts(spark, a) -> None:
    """Generated contexts for chunks that have none; the default takes the chunk's first words (0: all)."""
    chunks = spark.read.parquet(a.input).select("id", "text")
    todo = corpus.new_rows(chunks, spark.read.parquet(a.output)) if exists(spark, a.output) else chunks
    words = F.split("text", r"\s+")
    ctx = F.array_join(F.slice(words, 1, a.context_words) if a.context_words else words, " ")
    todo.select("id", ctx.alias("ctx")).write.mode("append").parquet(a.output)


def reembed(spark, a) -> None:
    """Chunks with their contexts (--contexts) into vectors and a BM25 index; only what changed is done again."""
    chunks = spark.read.parquet(a.input).select("id", "text")
    both = corpus.attach_context(chunks, spark.read.parquet(a.contexts)).withColumnRenamed("context", "ctx")
    texts = both.select("id", vectorstore.with_context(F.col("ctx"), F.col("text")).alias("text"))
    done = vectorstore.refresh(texts, f"{a.output}/vectors", models.hashing_embedder(a.dim), f"hashing-{a.dim}")
    words = inverted.refresh(texts.withColumnRenamed("id", "doc_id"), f"{a.output}/lexical")
    n = both.agg(F.count_if(F.col("ctx") != "").alias("used"), F.count("*").alias("n")).first()
    print(f"contextual coverage: {n['used']}/{n['n']}, embedded: {done['embedded']}, lexical buckets: {words['buckets']}")


def concepts(spark, a) -> None:
    """Concept file to one chunk per concept."""
    rows = corpus.concept_rows(readers.read_concepts(spark, a.input))
    corpus.concepts(rows, max_concepts=a.max_concepts or None).write.mode("overwrite").parquet(a.output)


JOBS = {"chunk": chunk, "index": index, "lexical": lexical_index, "shrink": shrink,
        "tree": summary_tree, "finalize": finalize, "contexts": contexts, "reembed": reembed, "concepts": concepts}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lensmere.jobs.build")
    p.add_argument("job", choices=sorted(JOBS))
    p.add_argument("--input", default="")
    p.add_argument("--output", required=True)
    p.add_argument("--source", default="QA")
    p.add_argument("--url-prefix", default="")
    p.add_argument("--prefix", default="chunk_")
    p.add_argument("--budget", type=int, default=chunking.GENERAL_BUDGET)
    p.add_argument("--overlap", type=int, default=chunking.GENERAL_OVERLAP)
    p.add_argument("--dim", type=int, default=models.EMBEDDING_DIM)
    p.add_argument("--append", action="store_true")
    p.add_argument("--force", action="store_true")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--sample", type=int, default=500)
    p.add_argument("--min-recall", type=float, default=0.95)
    p.add_argument("--apply", action="store_true")
    p.add_argument("--vectors", default="")
    p.add_argument("--contexts", default="")
    p.add_argument("--topics", type=int, default=1500)
    p.add_argument("--domains", type=int, default=0)
    p.add_argument("--cap", type=int, default=0)
    p.add_argument("--max-concepts", type=int, default=0)
    p.add_argument("--context-words", type=int, default=0)
    return p


def main(argv: list | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"lensmere-{a.job}").getOrCreate()
    ship(spark)
    JOBS[a.job](spark, a)


if __name__ == "__main__":
    main()
