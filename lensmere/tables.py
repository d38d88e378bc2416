"""Reading the input tables and the schema of the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CHUNK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("doc_id", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("drug_name", T.StringType()),
    T.StructField("drug_category", T.StringType()),
    T.StructField("rxcui", T.StringType()),
    T.StructField("condition_name", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("specialty", T.StringType()),
    T.StructField("evidence_level", T.StringType()),
    T.StructField("date_added", T.StringType()),
])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder (a pattern may be given) in the store of that path?"""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy text work one partition per core when the scan has fewer.

    A large table already has far more splits than cores and is returned as it
    is; only tables that fit in a few splits are redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores)


def even_keys(spark: SparkSession, n: int) -> list:
    """Whole numbers for n groups of much work each: a shuffle by them into n partitions gives each partition one."""
    key = F.col("id").cast("int")
    found = spark.range(40 * n).groupBy(F.pmod(F.hash(key), F.lit(n)).alias("part")).agg(F.min(key).alias("key")).collect()
    keys = {r["part"]: r["key"] for r in found}
    return [keys.get(i, -1 - i) for i in range(n)]
