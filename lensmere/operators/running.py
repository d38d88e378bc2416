"""Running values and ranks that stay parallel when one key is hot.

A plain window puts all rows of a key into one task.  Here each key is cut
into blocks by an expression that rises with the order; blocks are
aggregated, the block totals (few, small rows) are carried forward, and the
window runs inside a block only.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _blocked(df: DataFrame, keys: list, block: Column, totals: list, carried: list) -> DataFrame:
    """df with ``_block`` and the carried columns of all earlier blocks."""
    marked = df.withColumn("_block", block)
    per_block = marked.groupBy(*keys, "_block").agg(*totals)
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    # Null keys and null blocks are keys like others, so the totals are joined null-safe.
    named = {k: f"_carry_{i}" for i, k in enumerate([*keys, "_block"])}
    carry = per_block.select(
        *[F.col(k).alias(n) for k, n in named.items()], *[c(earlier) for c in carried])
    same = functools.reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()])
    return marked.join(carry, same).drop(*named.values())


def running_count(df: DataFrame, keys: list, order: list, block: Column,
                  name: str = "running") -> DataFrame:
    """1, 2, 3, ... per key in the given order; with no keys, over all rows.

    ``block`` must not decrease along the order, and equal order values must
    fall into one block.
    """
    joined = _blocked(
        df, keys, block, [F.count("*").alias("_n")],
        [lambda w: F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")])
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    return joined.withColumn(
        name, F.col("_before") + F.row_number().over(inside)
    ).drop("_block", "_before")


def last_before(df: DataFrame, keys: list, order: list, block: Column, value: Column,
                name: str) -> DataFrame:
    """The last non-null ``value`` strictly before each row."""
    marked = df.withColumn("_value", value)
    latest = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
    joined = _blocked(
        marked, keys, block, [latest.alias("_latest")],
        [lambda w: F.last("_latest", ignorenulls=True).over(w).alias("_carried")])
    inside = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(
        W.unboundedPreceding, -1)
    return joined.withColumn(
        name, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carried"))
    ).drop("_block", "_value", "_carried")


def order_statistics(df: DataFrame, column: str, ranks: dict, buckets: int = 4096) -> DataFrame:
    """Exact order statistics of a numeric column without sorting it.

    ``ranks`` maps a result name to a function of the row-count column giving
    the 0-based position.  A histogram finds the bucket of each position; only
    the values of those buckets are counted one by one.
    """
    x = F.col(column).cast("double")
    data = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    # Buckets are even on a logarithmic scale: a few far values leave the others spread.
    y = F.signum("x") * F.log1p(F.abs("x"))
    bounds = data.agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    bucket = F.when(hi > lo, F.least(
        F.lit(buckets - 1), F.floor((y - lo) / (hi - lo) * buckets))).otherwise(0)
    bucketed = data.withColumn("bucket", bucket.cast("int"))
    histogram = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
    upto = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    # At most ``buckets`` rows.
    spans = histogram.select(
        "bucket", (F.sum("n").over(upto) - F.col("n")).alias("first"), "n",
        F.sum("n").over(W.partitionBy()).alias("total"))
    wanted = spans.select(
        "bucket", "first", "n",
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("name"), rank(F.col("total")).cast("bigint").alias("at"))
            for name, rank in ranks.items()])).alias("w"),
    ).select("bucket", "first", "n", "w.name", "w.at").filter(
        (F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("n")))
    inside = bucketed.join(wanted.select("bucket").distinct(), "bucket", "left_semi").groupBy(
        "bucket", "x").agg(F.count("*").alias("m"))
    order = W.partitionBy("bucket").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    positioned = inside.withColumn("end", F.sum("m").over(order))
    hit = positioned.join(wanted, "bucket").filter(
        (F.col("at") - F.col("first") < F.col("end"))
        & (F.col("at") - F.col("first") >= F.col("end") - F.col("m")))
    return hit.select("name", F.col("x").alias("value"))
