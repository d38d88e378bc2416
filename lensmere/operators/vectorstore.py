"""Stored vectors of texts, re-embedded where the text changed and nowhere else.

Vectors lie in buckets of their id's hash below ``vectors/generation=g``; ``manifest/version=v`` says which
generation holds a bucket, and ``state/version=v``, written last, makes a version complete.  A text is known
by its hash, so a text that got a context is another text and is embedded again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lensmere.functions import text as X
from lensmere.operators.inverted import _versions
from lensmere.operators.models import Embedder
from lensmere.tables import exists

BUCKETS = 64


def with_context(context: Column, text: Column) -> Column:
    """The text that is embedded: context and body, or the body alone where there is no context."""
    both = F.concat(context, F.lit(" | "), X.or_empty(text))
    return F.when(X.or_empty(context) != "", F.regexp_replace(both, r"^[ |]+|[ |]+$", "")).otherwise(X.or_empty(text))


def _state(spark: SparkSession, folder: str) -> dict | None:
    for version in _versions(spark, folder)[:1]:
        return spark.read.parquet(f"{folder}/state/version={version}").first().asDict()
    return None


def _of(spark: SparkSession, folder: str, version: int, buckets: list | None = None) -> DataFrame | None:
    manifest = spark.read.parquet(f"{folder}/manifest/version={version}")
    rows = (manifest if buckets is None else manifest.filter(F.col("bucket").isin(buckets or [-1]))).collect()  # a row a bucket
    if not rows:
        return None
    return spark.read.option("basePath", f"{folder}/vectors").parquet(
        *[f"{folder}/vectors/generation={r['generation']}/bucket={r['bucket']}" for r in rows])


def refresh(chunks: DataFrame, folder: str, embedder: Embedder, model: str, buckets: int = BUCKETS) -> dict:
    """Bring the vectors up to (id, text); returns how many texts were embedded and how many buckets written.

    Equal rows have one vector.  Another model, or no index yet, embeds all.
    """
    spark = chunks.sparkSession
    before = _state(spark, folder)
    version = max(_versions(spark, folder), default=0) + 1
    if before is not None:
        buckets = before["buckets"]
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    now = chunks.select("id", F.xxhash64(X.or_empty(F.col("text"))).alias("print"), "text")
    have = None if before is None or before["model"] != model else _of(spark, folder, before["version"])
    rows = now.select("id", "print").distinct()
    if have is None:
        changed = rows.select("id", "print", F.lit(1).alias("came"))
    else:
        old = have.select("id", "print")
        changed = rows.join(old, ["id", "print"], "left_anti").withColumn("came", F.lit(1)).unionByName(
            old.join(rows, ["id", "print"], "left_anti").withColumn("came", F.lit(0)))
    changed.withColumn("bucket", bucket).write.mode("overwrite").parquet(f"{folder}/changes/version={version}")
    diff = spark.read.parquet(f"{folder}/changes/version={version}")
    counts = diff.agg(F.coalesce(F.sum("came"), F.lit(0)).alias("came"), F.count("*").alias("n")).first()
    if before is not None and not counts["n"]:
        return {"embedded": 0, "buckets": 0}
    touched = [r[0] for r in diff.select("bucket").distinct().collect()]  # at most one row per bucket
    keys = diff.filter("came = 1").select("id", "print")
    fresh = (now.join(keys, ["id", "print"], "left_semi").groupBy("id", "print").agg(F.first("text").alias("text"))
             .select("id", "print", embedder(X.or_empty(F.col("text"))).cast("array<float>").alias("embedding")))
    if have is not None:
        stay = _of(spark, folder, before["version"], touched)
        if stay is not None:
            gone = diff.filter("came = 0").select("id", "print")
            fresh = fresh.unionByName(stay.select("id", "print", "embedding").join(gone, ["id", "print"], "left_anti"))
    fresh.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/vectors/generation={version}")
    own = spark.createDataFrame([], "bucket int, generation int")
    if exists(spark, f"{folder}/vectors/generation={version}/bucket=*"):
        own = spark.read.parquet(f"{folder}/vectors/generation={version}").select("bucket", F.lit(version).alias("generation")).distinct()
    if have is not None:
        kept = spark.read.parquet(f"{folder}/manifest/version={before['version']}").filter(~F.col("bucket").isin(touched or [-1]))
        own = own.unionByName(kept)
    own.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")
    spark.createDataFrame([(version, buckets, model)], "version int, buckets int, model string").coalesce(1).write.mode(
        "overwrite").parquet(f"{folder}/state/version={version}")
    return {"embedded": int(counts["came"]), "buckets": len(touched)}


def vectors(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    """(doc_id, embedding) of the current version."""
    now = _state(spark, folder)
    if now is None:
        raise FileNotFoundError(f"no vectors in {folder}")
    if model is not None and now["model"] != model:
        raise ValueError(f"vectors were made by {now['model']}, not {model}")
    rows = _of(spark, folder, now["version"])
    if rows is None:
        return spark.createDataFrame([], "doc_id long, embedding array<float>")
    return rows.select(F.col("id").alias("doc_id"), "embedding")
