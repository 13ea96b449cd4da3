"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions.labels import label_language


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """The table ``name`` below ``folder``; column pruning and filters reach the scan.

    With ``spread``, a table of fewer splits than the cluster has cores is spread over them: worth a
    shuffle only where much is done with each row of a small file. Larger tables stay as they are; rows
    and results are the same either way.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores)
    return rows


def records(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """The table ``name`` with redelivered rows once and, where it has one, its language label as one of
    ``rw``, ``en``, ``fr`` and ``und`` (no clear label)."""
    rows = table(spark, folder, name, spread).dropDuplicates(["id"])
    return rows.withColumn("language", F.coalesce(label_language("language"), F.lit("und"))) if "language" in rows.columns else rows
