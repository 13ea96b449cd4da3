"""Pages of ordered lists, and nested children without fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataquill.session import checkpoint


def matching(rows: DataFrame, filters: list[Column | None]) -> DataFrame:
    """Rows that pass every filter given; absent filters let everything pass."""
    for test in filters:
        if test is not None:
            rows = rows.where(test)
    return rows


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Total rows, total pages, and whether there are pages before and after."""
    counted = rows.agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / size)
    return counted.select("total", pages.alias("pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_previous"))


def nest(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str, fields: list[str]) -> DataFrame:
    """Parents with the array ``name`` of their children: each child table is grouped before it is
    joined, so several of them do not multiply. Parents without children get an empty array."""
    grouped = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    kind = grouped.schema[name].dataType.simpleString()
    return parents.join(grouped, parent_key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def whole_percent(part: Column, whole: Column) -> Column:
    """A share in percent, rounded half up; 0 of nothing."""
    return F.when(whole > 0, F.floor(100 * part / whole + 0.5)).otherwise(F.lit(0).cast("long"))


def numbered(rows: DataFrame, partition: str, order: str, name: str = "n") -> DataFrame:
    """``rows`` with their number (from 1) by ``order`` within ``partition``, of which a few values may
    hold all rows: the rows are sorted in ranges of both, numbered inside a range, and moved by the
    numbers of the ranges before (one small row a range and value)."""
    ranged = checkpoint(rows.repartitionByRange(partition, order).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy("__range", partition).orderBy(order)
    sizes = ranged.groupBy(partition, "__range").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(partition).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(partition).alias("__p"), F.col("__range").alias("__r"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    local = ranged.withColumn("__n", F.row_number().over(inside))
    joined = local.join(F.broadcast(offsets), local[partition].eqNullSafe(offsets["__p"]) & (local["__range"] == offsets["__r"]))
    return joined.withColumn(name, F.col("__n") + F.col("__before")).drop("__range", "__n", "__p", "__r", "__before")
