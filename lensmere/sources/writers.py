"""Sinks: chunk tables, index tables, reports, audit records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lensmere.functions import vectors as V
from lensmere.operators import dense


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by source, so a corpus can be read or replaced alone."""
    chunks.write.mode(mode).partitionBy("source").parquet(path)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite",
                rows_per_file: int = 1_000_000) -> None:
    """JSON lines; files roll over after a number of rows."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).json(path)


def write_vector_index(chunks: DataFrame, path: str, model: str, mode: str = "overwrite") -> None:
    """Unit-length vectors with their ids, and one row describing the index.

    ``chunks``: (id, embedding).  Vectors are keyed, never positional.  Mode
    ``append`` adds vectors and describes the whole index anew.
    """
    unit = chunks.select("id", V.normalised(F.col("embedding")).cast("array<float>")
                         .alias("embedding"))
    unit.write.mode(mode).parquet(f"{path}/vectors")
    written = chunks.sparkSession.read.parquet(f"{path}/vectors")
    written.agg(
        F.count("*").alias("total_chunks"), F.max(F.size("embedding")).alias("dimension"),
        F.lit(model).alias("embedding_model"), F.lit("inner_product").alias("metric"),
    ).write.mode("overwrite").json(f"{path}/config")


def open_vector_index(spark: SparkSession, path: str, chunks: DataFrame,
                      model: str | None = None) -> DataFrame:
    """The vectors, after checking that index, chunks and model belong together."""
    config = spark.read.json(f"{path}/config").first()
    if model is not None and config["embedding_model"] != model:
        raise ValueError(f"index was built with {config['embedding_model']}, not {model}")
    if "codes" in config.asDict().values():
        vectors = dense.decode(spark.read.parquet(f"{path}/codes"), spark.read.parquet(
            f"{path}/ranges")).withColumnRenamed("doc_id", "id")
    else:
        vectors = spark.read.parquet(f"{path}/vectors")
    problems = integrity(vectors, chunks).first()
    if problems["without_vector"] or problems["without_chunk"]:
        raise ValueError(f"index and chunks differ: {problems.asDict()}")
    return vectors


def describe_codes(spark: SparkSession, path: str, codes: str) -> None:
    """Give codes made from an index its description, so that they open like it."""
    spark.read.json(f"{path}/config").withColumn("storage", F.lit("codes")).write.mode(
        "overwrite").json(f"{codes}/config")


def integrity(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: chunks, vectors, and how many of each lack the other."""
    both = chunks.select("id", F.lit(1).alias("c")).join(
        vectors.select("id", F.lit(1).alias("v")), "id", "full")
    return both.agg(
        F.count("c").alias("chunks"), F.count("v").alias("vectors"),
        F.count_if(F.col("v").isNull()).alias("without_vector"),
        F.count_if(F.col("c").isNull()).alias("without_chunk"))


def swap_index(spark: SparkSession, measured_recall: float, minimum: float, current: str,
               candidate: str, backup: str) -> None:
    """Replace an index by a candidate good enough, keeping the old one.

    Refuses when recall is too low or a backup already exists.
    """
    if measured_recall < minimum:
        raise ValueError(f"recall {measured_recall:.4f} is below {minimum}; nothing was changed")
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    old, new, kept = (jvm.org.apache.hadoop.fs.Path(p) for p in (current, candidate, backup))
    fs = old.getFileSystem(conf)
    if fs.exists(kept):
        raise ValueError(f"a backup already exists: {backup}")
    if not fs.rename(old, kept):
        raise IOError("the index could not be moved aside")
    if not fs.rename(new, old):
        fs.rename(kept, old)
        raise IOError("the new index could not be moved into place; the old one is back")


def report(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
