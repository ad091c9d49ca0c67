"""Local time of commits: an instant and the offset recorded with it, never the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(instant: Column, offset_minutes: Column) -> Column:
    """Wall-clock time (timestamp_ntz) of an instant (timestamp_ntz in UTC) in its own offset."""
    return instant.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), offset_minutes.cast("int"), F.lit(0).cast("decimal(18,6)"))


def epoch_seconds(local: Column) -> Column:
    """Whole seconds of a wall-clock time, counted as if it were UTC."""
    return F.unix_seconds(local.cast("timestamp"))


def monday_zero(date: Column) -> Column:
    return F.weekday(date)


def is_night(hour: Column) -> Column:
    return (hour >= 22) | (hour < 6)


def is_early(hour: Column) -> Column:
    return (hour >= 5) & (hour < 9)


def is_office(hour: Column, weekday: Column) -> Column:
    return (weekday < 5) & (hour >= 9) & (hour < 18)


def is_friday_evening(hour: Column, weekday: Column) -> Column:
    return (weekday == 4) & (hour >= 17)
