"""Streams run over everything that is there, with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.streaming import audit


def stream_rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.drain(audit.rate_limit(audit.events_stream(spark, folder), 2), ["user_id", "start"])


def stream_rolling_30d(spark: SparkSession, folder: str) -> DataFrame:
    return audit.drain(audit.rolling_counts(audit.events_stream(spark, folder)), ["event_type", "start"])


def stream_once(spark: SparkSession, folder: str) -> DataFrame:
    stream = audit.once(audit.events_stream(spark, folder)).select("event_id", "user_id", "event_type")
    return audit.drain(stream).select("event_id", "user_id", "event_type")


def stream_audit_append(spark: SparkSession, folder: str) -> DataFrame:
    stream = audit.events_stream(spark, folder).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return audit.drain(stream).select("event_id", "k")


QUERIES = {f.__name__: f for f in (stream_rate_limit, stream_rolling_30d, stream_once, stream_audit_append)}
ORACLES = {
    "stream_rate_limit": "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2",
    "stream_rolling_30d": "SELECT event_type, strftime(d, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('day', ts) - INTERVAL 29 DAYS, date_trunc('day', ts), INTERVAL 1 DAY)) AS d FROM events) GROUP BY ALL",
    "stream_once": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "stream_audit_append": "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events",
}
