"""The corpus pipeline: documents in, the token ids of the training mix out.

Documents that the quality classifier rejects go, one document of each group of near-duplicates stays,
passages that an earlier document holds are cut, sources are mixed to their weights, and the mix is
encoded.  Every stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lensmere.llm import minhash, mixing, pieces, quality, shared, spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of trusted text accepts."""
    shared.prepared(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classified(docs.select(COLUMNS), labels).where("accepted").select(COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five words, 0.8); of repeated rows one."""
    shared.prepared(spark)
    # Ids may be null or repeated; (is it null, id, number of the row) is neither.  The numbers are
    # written, as those of another job may differ.
    rows = shared.staged(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("key"), "text")
    gone = minhash.near_duplicates(keyed, key="key").where("not kept").select(F.col("key._row").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; ``n_chars`` counts what is left."""
    shared.prepared(spark)
    out = spans.without_repeats(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, dealt to the mix's shards and shuffled within each."""
    shared.prepared(spark)
    return mixing.mixed(docs.select(COLUMNS)).repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_place").select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to, a row per row of the mix."""
    shared.prepared(spark)
    return pieces.decoded(pieces.encoded(docs.select("doc_id", "text"))).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

# Perplexities, draws and byte-pair merges are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
