"""Streaming views of an append-only log. The same functions take batch and streaming DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strataquill.session import shared_folder


def events_stream(spark: SparkSession, folder: str, name: str = "events", files_per_trigger: int = 50) -> DataFrame:
    """The table ``name`` below ``folder`` as a stream of its files, with the schema of what is there."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def rate_limit(events: DataFrame, limit: int, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(user_id, start, n) of the fixed windows in which a user has more than ``limit`` events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > limit).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def rolling_counts(events: DataFrame, width: str = "30 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """(event_type, start, n) of sliding windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy("event_type", F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("start"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Events without repeats of ``key`` that arrive within ``late`` of one another (streams), or at all."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else timed.dropDuplicates([key])


def retained(events: DataFrame, days: int, now: F.Column) -> DataFrame:
    """Events no older than ``days`` (between 1 and 365)."""
    return events.where(F.col("ts").cast("timestamp") > now - F.make_dt_interval(F.lit(min(max(days, 1), 365))))


def drain(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What a stream has to say about all data that is there now, read back as a batch.

    Each trigger adds its rows by ``foreachBatch`` to the shared checkpoint folder, so a lost executor
    loses nothing and no result is written twice. With ``keys`` a trigger writes only the groups that
    changed (update mode, in which the watermark evicts closed windows from the state), and the newest
    row of each key counts.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode("update" if keys else "append").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    if not keys:
        return rows.drop("batch")
    others = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("newest"))
    return newest.select(*(c if c in keys else F.col(f"newest.{c}").alias(c) for c in stream.columns))
