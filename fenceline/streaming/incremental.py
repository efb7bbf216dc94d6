"""Incremental detection over an event stream: windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days", fence: str = "error") -> DataFrame:
    """(start, op, n, n_fenced) for each window of event time; rows later than ``late`` are dropped by the stream.

    ``events`` may be a stream or a table; times without a zone are taken in the session's zone.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    out = timed.groupBy(F.window("at", width), F.col("event_type").alias("op")).agg(F.count("*").alias("n"), F.sum((F.col("event_type") == fence).cast("int")).alias("n_fenced"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "op", "n", "n_fenced")


QUERIES = {"windowed_counts": lambda s, d: windowed(s.read.parquet(f"{d}/events.parquet"))}
ORACLES = {
    "windowed_counts": """SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS op, count(*) AS n, (count(*) FILTER (event_type = 'error'))::BIGINT AS n_fenced FROM events GROUP BY ALL"""
}
