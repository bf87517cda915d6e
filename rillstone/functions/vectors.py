"""Column functions for vectors (arrays of numbers), in double precision and on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is null or has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def dimensions(v: Column, size: int, prefix: str = "emb_") -> list[Column]:
    """The first ``size`` numbers as columns; a null vector gives zeros, a short one nulls at its end."""
    return [F.when(v.isNull(), F.lit(0.0)).otherwise(F.get(doubles(v), F.lit(i))).alias(f"{prefix}{i}") for i in range(size)]
