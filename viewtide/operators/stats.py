"""Totals, grouped statistics and the most-watched stream.

Every group-by here has combinable aggregates, so Spark pre-aggregates on the map side and a
hot key reaches the exchange as one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame) -> DataFrame:
    """One row: total duration, interactions, distinct users, distinct streams."""
    return df.agg(
        F.coalesce(F.sum("duration"), F.lit(0)).alias("total_duration"),
        F.count(F.lit(1)).alias("interactions"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("stream_id").alias("streams"),
    )


def stream_watch_time(df: DataFrame) -> DataFrame:
    """Total duration of each stream."""
    return df.groupBy("stream_id").agg(F.sum("duration").alias("duration"))


def user_distinct_streams(df: DataFrame) -> DataFrame:
    """Number of different streams of each user."""
    return df.groupBy("user_id").agg(F.count_distinct("stream_id").alias("streams"))


def user_stream_sets(df: DataFrame) -> DataFrame:
    """The user-to-streams map in long form: one row per distinct pair.

    The long form carries what a set per user would, without building one large array for a
    heavy user.
    """
    return df.select("user_id", "stream_id").distinct()


def most_watched_stream(df: DataFrame, order_col: str = "row_id") -> DataFrame:
    """Stream with the largest total duration; of equals, the one seen first. Empty in, empty out."""
    totals = df.groupBy("stream_id").agg(
        F.sum("duration").alias("duration"), F.min(order_col).alias("_first")
    )
    best = totals.agg(
        F.max_by(F.struct("stream_id", "duration"), F.struct("duration", -F.col("_first"))).alias("_top")
    )
    return best.where(F.col("_top").isNotNull()).select("_top.stream_id", "_top.duration")


def _seen(c: str, fit_on: Column | None) -> Column:
    return F.col(c) if fit_on is None else F.when(fit_on, F.col(c))


def streamer_watch_time(df: DataFrame, duration: str = "duration", fit_on: Column | None = None) -> DataFrame:
    """Popularity by watch time: total duration of each streamer.

    ``fit_on`` limits the rows the statistic may see (say, the training part). ``rows``
    always counts all rows of the key; ``join_back`` uses it to find hot keys.
    """
    return (
        df.where(F.col("streamer").isNotNull())
        .groupBy("streamer")
        .agg(F.sum(_seen(duration, fit_on)).alias("total_watch_time"), F.count(F.lit(1)).alias("rows"))
    )


def user_stats(
    df: DataFrame,
    duration: str = "duration",
    count_name: str = "num_streams_watched",
    fit_on: Column | None = None,
) -> DataFrame:
    """Interactions (rows with a stream, repeats included) and mean duration of each user."""
    return (
        df.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.count(_seen("stream_id", fit_on)).alias(count_name),
            F.avg(_seen(duration, fit_on)).alias("avg_duration"),
            F.count(F.lit(1)).alias("rows"),
        )
    )


def streamer_popularity(df: DataFrame, fit_on: Column | None = None) -> DataFrame:
    """Popularity by row count. Sort by it only where the table is shown."""
    return (
        df.where(F.col("streamer").isNotNull())
        .groupBy("streamer")
        .agg(F.count(_seen("streamer", fit_on)).alias("popularity"), F.count(F.lit(1)).alias("rows"))
    )


def _by_fold(value: Column, fold: str, k: int, aggregate=F.sum) -> Column:
    """An array with the aggregate of each of the folds 0..k-1."""
    return F.array(*[F.coalesce(aggregate(F.when(F.col(fold) == i, value)), F.lit(0)) for i in range(k)])


def streamer_watch_time_by_fold(df: DataFrame, k: int, fold: str = "fold", duration: str = "duration") -> DataFrame:
    """Total duration of each streamer in every fold, as an array; one pre-aggregated exchange for all folds."""
    return (
        df.where(F.col("streamer").isNotNull())
        .groupBy("streamer")
        .agg(_by_fold(F.col(duration), fold, k).alias("watch_time"), F.count(F.lit(1)).alias("rows"))
    )


def user_stats_by_fold(df: DataFrame, k: int, fold: str = "fold", duration: str = "duration") -> DataFrame:
    """Per user and fold what ``user_stats`` is made of: interactions, durations and their number, as arrays."""
    return (
        df.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            _by_fold(F.col("stream_id"), fold, k, F.count).alias("streams"),
            _by_fold(F.col(duration), fold, k).alias("durations"),
            _by_fold(F.col(duration), fold, k, F.count).alias("sessions"),
            F.count(F.lit(1)).alias("rows"),
        )
    )


def outside(parts: str, fold: str = "fold") -> Column:
    """Sum of an array of per-fold values over all folds but the row's own; null for a missing array."""
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return total - F.get(parts, F.col(fold))


def label_range(df: DataFrame, label: str) -> DataFrame:
    """Smallest and largest label, the bounds of a plot axis."""
    return df.agg(F.min(label).alias("min_label"), F.max(label).alias("max_label"))
