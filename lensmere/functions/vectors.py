"""Vector expressions on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
        F.lit(0.0), lambda s, x: s + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    length = norm(v)
    return F.when(length == 0, as_double(v)).otherwise(
        F.transform(as_double(v), lambda x: x / length)
    )
