"""Column rules for epoch values, event time, latency and tolerant coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
MILLISECOND_LIMIT = 1e12  # strictly above: epoch milliseconds
V1_TIME_PATTERN = "yyyy-MM-dd HH:mm:ss"
FIRST_SECOND = -62135596800.0  # 0001-01-01
LAST_SECOND = 253402300799.0  # 9999-12-31T23:59:59


def number(value: Column) -> Column:
    """Numeric reading of anything; unreadable text and NaN become null."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def epoch_seconds(value: Column) -> Column:
    """Epoch seconds from a value that is in seconds or in milliseconds."""
    plain = number(value)
    return plain / F.when(plain > F.lit(MILLISECOND_LIMIT), F.lit(1000.0)).otherwise(F.lit(1.0))


def seconds_to_timestamp(seconds: Column) -> Column:
    """Whole-second timestamp; null outside the years 1 to 9999."""
    usable = F.when(seconds.between(FIRST_SECOND, LAST_SECOND), seconds)
    return F.timestamp_seconds(usable.try_cast("bigint"))


def event_timestamp(seconds: Column, arrival: Column) -> Column:
    """Producer time when usable, else arrival time."""
    return F.coalesce(seconds_to_timestamp(seconds), arrival)


def latency_ms(arrival: Column, seconds: Column, clamp: bool = True) -> Column:
    """Milliseconds from producer to arrival.

    Clamped: never negative, and 0.0 (not null) without a producer time. Unclamped: may be
    negative, null without a producer time.
    """
    raw = (arrival.cast("double") - seconds) * F.lit(1000.0)
    return F.greatest(F.lit(0.0), raw) if clamp else raw


def coerce_timestamp(value: Column, dtype: T.DataType) -> Column:
    """UTC timestamp from text, date, timestamp or an epoch number; bad input becomes null."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.try_to_timestamp(value, F.lit(V1_TIME_PATTERN)), value.try_cast("timestamp"))
    if isinstance(dtype, T.NumericType):
        return seconds_to_timestamp(epoch_seconds(value))
    return value.try_cast("timestamp")


def drop_zone(value: Column) -> Column:
    """The same instant as a zone-less timestamp (the session zone is UTC)."""
    return value.cast("timestamp_ntz")


def floor_minute(value: Column) -> Column:
    return F.date_trunc("minute", value)


def floor_seconds(value: Column, seconds: int) -> Column:
    return F.window(value, f"{seconds} seconds")["start"]
