"""A join that no hot key can break."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_key_join(rows: DataFrame, lookup: DataFrame, keys: list[str], share: int = 200) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` (at most one row per key) where keys may be hot.

    The rows are counted per key with map-side combine. Keys that hold more than 1/``share`` of all
    rows are fewer than ``share``, so their part of ``lookup`` is broadcast; all other keys meet in a
    shuffle. Null keys match nothing. Empty inputs give an empty result.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.agg(F.count(F.lit(1)))
    hot = counts.where(F.col("__n") * share > total.scalar()).select(*keys)
    by_hot = rows.join(F.broadcast(lookup.join(F.broadcast(hot), keys, "left_semi")), keys)
    by_rest = rows.join(F.broadcast(hot), keys, "left_anti").join(lookup, keys)
    return by_hot.unionByName(by_rest)
