"""The entry module must work from any folder, before a session exists."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
assert set(entry.oracle_sql()) <= set(entry.queries())
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
print("rows", entry.entry(spark).count())
"""


def test_entry_from_another_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=clean,
                          capture_output=True, text=True, timeout=300)
    assert "rows 400" in done.stdout, done.stderr[-2000:]
