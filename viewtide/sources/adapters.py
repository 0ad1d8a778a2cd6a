"""Viewing logs made from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.functions.arithmetic import int_div
from viewtide.schema import EVENTS

# Fixed value: 2024-01-01 in 10-minute units since 1970, the origin of the derived log.
LOG_ORIGIN = 2_840_112


def _epoch_seconds(ts: Column) -> Column:
    # Taken apart field by field: a zone-less timestamp then never meets the session time zone.
    days = F.unix_date(ts.cast("date")).cast("bigint")
    return days * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


def _epoch_nanos(ts: Column) -> Column:
    minutes = int_div(_epoch_seconds(ts), F.lit(60)) * 60_000_000_000
    return minutes + (F.extract(F.lit("SECOND"), ts) * 1_000_000_000).cast("bigint")


def events_log(spark: SparkSession, folder: str, unit: str = "10min") -> DataFrame:
    """The ``events`` table read as a viewing log.

    The event type stands for the streamer and the ``k`` property for the stream. Times count
    10-minute units since the start of the log, or seconds or nanoseconds since 1970. A plain
    projection, so column pruning and filters on ``row_id`` reach the Parquet scan.
    """
    events = spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")
    ts = F.col("ts")
    start = {
        "10min": int_div(_epoch_seconds(ts), F.lit(600)) - LOG_ORIGIN,
        "sec": _epoch_seconds(ts),
        "ns": _epoch_nanos(ts),
    }[unit]
    duration = 1 + F.floor(F.col("value") / 10).cast("bigint")
    return events.select(
        F.col("event_id").alias("row_id"),
        "user_id",
        F.get_json_object("props", "$.k").alias("stream_id"),
        F.col("event_type").alias("streamer"),
        start.alias("start_time"),
        (start + duration).alias("stop_time"),
        duration.alias("duration"),
    )
