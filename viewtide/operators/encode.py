"""Scaling and one-hot encoding as SQL expressions over one-row statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.functions.times import DAY_NAMES, DAY_PARTS

#: All levels of the two categories, in sorted order.
CATEGORY_LEVELS = {
    "time_of_day": tuple(sorted(name for name, _, _ in DAY_PARTS)),
    "day_of_week": tuple(sorted(DAY_NAMES)),
}


def scaled_column(value: Column, low: Column, high: Column) -> Column:
    """``value`` scaled by a range of doubles; 0 where the range is a single value that ``value`` equals."""
    moved = value.cast("double") - low
    return F.when(high == low, moved).otherwise(moved / (high - low))


def level_name(column: str, level: str) -> str:
    return f"{column}_{level.lower()}"


def hot_column(value: Column, level: str) -> Column:
    return F.coalesce((value == level).cast("int"), F.lit(0))


def minmax_scale(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Scale columns to [0, 1] by the range seen in ``fit_on`` (default: all rows).

    A constant column becomes 0. The ranges are one scalar subquery.
    """
    source = df if fit_on is None else fit_on
    ranges = source.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"min_{c}") for c in columns],
            *[F.max(c).cast("double").alias(f"max_{c}") for c in columns],
        ).alias("ranges")
    ).scalar()
    scaled = {}
    for c in columns:
        scaled[c] = scaled_column(F.col(c), F.col(f"_ranges.min_{c}"), F.col(f"_ranges.max_{c}"))
    return df.withColumn("_ranges", ranges).select(
        *[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns]
    )


def one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]] = CATEGORY_LEVELS) -> DataFrame:
    """Replace each category by one 0/1 column per level; a null category gives all zeros."""
    hot = [
        hot_column(F.col(c), level).alias(level_name(c, level))
        for c, names in levels.items()
        for level in names
    ]
    return df.select(*[c for c in df.columns if c not in levels], *hot)
