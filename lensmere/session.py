"""Session settings for local runs, tests and the benchmark."""

from __future__ import annotations

import ctypes
import os
import tempfile
import threading
import uuid
import zipfile

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lensmere", cores: int | None = None) -> SparkSession:
    """A local session with the settings the operators are tuned for.

    On a cluster the session is created by spark-submit; none of the operators
    needs anything beyond Spark's defaults.
    """
    cores = cores or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LENSMERE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows pass between Spark and Python in batches of at most so many bytes.
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Texts differ widely in length, so batches are bounded by bytes, not only by rows; the setting stays for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def checkpoint_folder(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The folder for checkpoints and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  A fallback is used only
    where that setting is absent (tests on one machine).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if folder:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path for written tables that nobody else uses, below the shared checkpoint folder."""
    base = checkpoint_folder(spark)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="lensmere-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame, kind: str) -> DataFrame:
    """The rows written as a table and read again; the files go when the application ends.

    On a cluster that names no shared folder the executors keep the rows on their disks instead.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
        return df.persist(StorageLevel.DISK_ONLY)
    path = new_folder(spark, kind)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def free_memory(after: float | None = None) -> None:
    """Give back what a Python worker no longer uses: Spark keeps the worker for later stages, with all it holds.

    ``after``: once more after so many seconds, when the caller's result has been sent and its input dropped.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    if after is not None:
        later = threading.Timer(after, free_memory)
        later.daemon = True
        later.start()


#: Seconds in which a worker has sent the rows of a cell.
SENT_AFTER = 2.0

_shipped: set = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Not needed where it is installed on every node or passed with --py-files.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="lensmere-"), "lensmere.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
