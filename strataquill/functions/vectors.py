"""Vector functions on arrays, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null where either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector counts as if its length product were one."""
    size = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return inner_product(a, b) / F.coalesce(F.nullif(size, F.lit(0.0)), F.lit(1.0))


def vector_literal(a: Column) -> Column:
    """``[a,b,...]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))
