"""Intermediate tables in the folder all executors share, and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lensmere.session import checkpoint_folder, ship

#: Rows pass between Spark and Python in batches of at most so many bytes.
BATCH_BYTES = "8m"

_fallback: dict[str, str] = {}


def prepared(spark: SparkSession) -> None:
    """Make the package known to the Python workers and bound what they hold at a time.

    Texts differ widely in length, so batches are bounded by bytes, not only by rows; the setting stays
    for the session.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def tidy(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """A function on Arrow batches that leaves no memory behind: Spark keeps its Python workers for later stages."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, removed when the application ends.

    Where that setting is absent (tests on one machine) a temporary folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _fallback:
            _fallback[app] = tempfile.mkdtemp(prefix="lensmere-")
        root = checkpoint_folder(spark, _fallback[app])
    path = f"{root.rstrip('/')}/lensmere-llm-{uuid.uuid4().hex}"
    store, where = _file_system(spark, path)
    store.deleteOnExit(where)
    return path


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def staged(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The rows written as a table and read again: lost executors cost no recomputation beyond it."""
    path = folder(df.sparkSession)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lensmere_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    path = getattr(df, "_lensmere_path", None)
    if path:
        fs, where = _file_system(df.sparkSession, path)
        fs.delete(where, True)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node that can be reached.

    Alternates large and small stars: each round hangs neighbours under the smallest node seen, and the
    number of links never grows.  A node with very many links is pre-aggregated before the shuffle, and
    the join back splits it.  Links with a null end are left out.
    """
    edges = staged(links.select("a", "b").where("a is not null and b is not null and a <> b")
                   .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(small_low.withColumnRenamed("a", "c"), F.col("a") == F.col("c"))
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.*").where("a <> b").distinct())
        new = staged(small)
        dropped(edges)
        edges = new
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
