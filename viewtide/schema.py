"""Column names and schemas shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

#: The five raw fields of a viewing log, in file order.
RAW_FIELDS = ("user_id", "stream_id", "streamer", "start_time", "stop_time")

#: Raw fields that must hold whole numbers.
INTEGER_FIELDS = ("user_id", "start_time", "stop_time")

#: Raw fields as they come out of the text reader; casting is a separate, checked step.
TEXT_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_FIELDS])

#: The typed interaction table every operator takes as input.
INTERACTIONS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("stream_id", T.StringType()),
        T.StructField("streamer", T.StringType()),
        T.StructField("start_time", T.LongType()),
        T.StructField("stop_time", T.LongType()),
        T.StructField("duration", T.LongType()),
    ]
)

#: Columns of the events table that the log adapter reads.
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

TREE_FEATURES = (
    "total_watch_time",
    "num_streams_watched",
    "avg_duration",
    "hour_of_day",
    "day_of_week",
    "prev_session_duration",
)
TREE_LABEL = "engagement_duration"

ENCODED_NUMERIC = ("streams_watched", "avg_duration", "popularity", "prev_session_duration")
ENCODED_CATEGORIES = ("time_of_day", "day_of_week")
ENCODED_LABEL = "duration"
