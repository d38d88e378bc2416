"""Blocked windows keep rows with null keys and null blocks."""

from pyspark.sql import functions as F

from lensmere.operators import chunking, running


def test_null_keys_and_blocks_are_counted(spark):
    rows = [("a", 1), (None, 2), (None, 3), ("a", None), ("a", 12), (None, None)]
    df = spark.createDataFrame(rows, "k string, n long")
    got = running.running_count(df, ["k"], ["n"], F.floor(F.col("n") / 10)).collect()
    assert sorted((str(r.k), str(r.n), r.running) for r in got) == sorted([
        ("a", "None", 1), ("a", "1", 2), ("a", "12", 3), ("None", "None", 1), ("None", "2", 2), ("None", "3", 3)])


def test_last_before_with_null_keys(spark):
    rows = [(None, 1, "x"), (None, 2, None), (None, 30, None), ("a", 1, "y"), ("a", 2, None)]
    df = spark.createDataFrame(rows, "k string, n long, v string")
    got = running.last_before(df, ["k"], ["n"], F.floor(F.col("n") / 10), F.col("v"), "before").collect()
    assert {(r.k, r.n): r.before for r in got} == {
        (None, 1): None, (None, 2): "x", (None, 30): "x", ("a", 1): None, ("a", 2): "y"}


def test_chunks_of_text_ids_are_numbered(spark):
    rows = [(f"doc-{i // 3:04}", i % 3, "t") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_index int, text string")
    got = chunking.number_chunks(df, "c_", 3).orderBy("doc_id", "chunk_index").collect()
    assert [r.id for r in got] == [f"c_{i:03}" for i in range(30)]


def test_order_statistics_with_far_values(spark):
    values = [float(i % 200) for i in range(2000)] + [1e12, -1e9, 0.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ranks = {"low": lambda n: F.lit(0), "middle": lambda n: F.floor(n / 2), "high": lambda n: n - 1}
    got = {r.name: r.value for r in running.order_statistics(df, "x", ranks).collect()}
    ordered = sorted(values)
    assert got == {"low": ordered[0], "middle": ordered[len(values) // 2], "high": ordered[-1]}
