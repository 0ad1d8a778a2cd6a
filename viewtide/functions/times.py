"""Time-of-day and day features of an integer time in one of three units.

All of it is integer arithmetic on the stored value, so results depend neither on the
session time zone nor on double precision, and whole-stage codegen covers every step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from viewtide.functions.arithmetic import floor_div

# How many ticks of each unit make one hour.
TICKS_PER_HOUR = {"ns": 3_600_000_000_000, "sec": 3_600, "10min": 6}

# Day names by relative day number, and the four parts of a day with their
# first and one-past-last hour.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
DAY_PARTS = (("Night", 0, 6), ("Morning", 6, 12), ("Afternoon", 12, 18), ("Evening", 18, 24))

# 1970-01-01 was a Thursday; with Monday as 0 that is 3.
EPOCH_WEEKDAY = 3


def _ticks_per_hour(unit: str) -> int:
    try:
        return TICKS_PER_HOUR[unit]
    except KeyError:
        raise ValueError(f"unit must be one of {sorted(TICKS_PER_HOUR)}, not {unit!r}") from None


def hour_of_day(t: Column, unit: str) -> Column:
    """Hour 0-23."""
    return F.pmod(floor_div(t, _ticks_per_hour(unit)), F.lit(24)).cast("int")


def relative_day(t: Column, unit: str) -> Column:
    """Day number 0-6 counted from the log's own origin, not a calendar weekday."""
    return F.pmod(floor_div(t, 24 * _ticks_per_hour(unit)), F.lit(7)).cast("int")


def calendar_weekday(t: Column, unit: str) -> Column:
    """Calendar weekday of a time counted from the Unix epoch, Monday = 0."""
    day = floor_div(t, 24 * _ticks_per_hour(unit))
    return F.pmod(day + F.lit(EPOCH_WEEKDAY), F.lit(7)).cast("int")


def day_of_week(t: Column, unit: str) -> Column:
    """Day feature of the tree models: calendar weekday for ``ns``, relative day otherwise."""
    return calendar_weekday(t, unit) if unit == "ns" else relative_day(t, unit)


def epoch_timestamp(t: Column) -> Column:
    """Integer nanoseconds since the epoch as a timestamp (microseconds, rounded down)."""
    return F.timestamp_micros(floor_div(t, 1_000))


def time_of_day(hour: Column) -> Column:
    """Part of the day an hour falls in; null outside 0-23."""
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, first, end in DAY_PARTS:
        label = label.when((hour >= first) & (hour < end), F.lit(name))
    return label


def time_of_day_order(hour: Column) -> Column:
    """Position of the part of the day (0 = Night), for ordered output."""
    rank = F.when(F.lit(False), F.lit(None).cast("int"))
    for position, (_, first, end) in enumerate(DAY_PARTS):
        rank = rank.when((hour >= first) & (hour < end), F.lit(position))
    return rank


def day_label(t: Column, unit: str) -> Column:
    """Name of the relative day, day 0 being Sunday."""
    names = F.array(*[F.lit(name) for name in DAY_NAMES])
    return F.element_at(names, relative_day(t, unit) + 1)
