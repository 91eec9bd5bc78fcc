"""Raw messages to stored events. One DataFrame function, used by batch and stream alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, times
from ..schemas import EVENT_STORED, EVENT_WIRE

REQUIRED = ("source_id", "emotion")


def parse_messages(
    raw: DataFrame,
    schema: T.StructType = EVENT_WIRE,
    required: Sequence[str] = REQUIRED,
    value: str = "value",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Typed events from a JSON ``value`` column; rows lacking a required field are left out."""
    parsed = raw.select(*keep, text.parse_json(F.col(value), schema).alias("_json")).select(*keep, "_json.*")
    return valid_events(parsed, required)


def valid_events(events: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    for name in required:
        events = events.where(F.col(name).isNotNull())
    return events


def enrich(
    events: DataFrame,
    arrival: Column | None = None,
    clamp: bool = True,
    mark_producer_ts: bool = False,
) -> DataFrame:
    """Arrival time, event time, its minute and date, and latency.

    ``arrival`` defaults to the batch's current time. Without a producer time the event time
    is the arrival time and the clamped latency is 0.0, which pulls percentiles down;
    ``mark_producer_ts`` adds ``has_producer_ts`` to tell those rows apart. A producer time
    outside the years 1 to 9999, or NaN, counts as missing for the event time.
    """
    arrived = F.current_timestamp() if arrival is None else arrival
    staged = events.withColumns(
        {"spark_ts": arrived.cast("timestamp"), "producer_ts_sec": times.epoch_seconds(F.col("producer_ts"))}
    )
    staged = staged.withColumn("event_ts", times.event_timestamp(F.col("producer_ts_sec"), F.col("spark_ts")))
    staged = staged.withColumns(
        {
            "event_time": F.col("event_ts"),
            "event_minute": times.floor_minute(F.col("event_ts")),
            "event_date": F.to_date("event_ts"),
            "e2e_latency_ms": times.latency_ms(F.col("spark_ts"), F.col("producer_ts_sec"), clamp),
            "processing_time_ms": F.lit(None).cast("double"),
        }
    )
    columns = EVENT_STORED.fieldNames()
    if mark_producer_ts:
        staged = staged.withColumn("has_producer_ts", F.col("producer_ts_sec").isNotNull())
        columns = [*columns, "has_producer_ts"]
    return staged.select(*columns)


def ingest(
    raw: DataFrame,
    arrival: str | None = None,
    required: Sequence[str] = REQUIRED,
    clamp: bool = True,
) -> DataFrame:
    """Messages with a ``value`` column to stored events.

    ``arrival`` names a timestamp column of ``raw`` to use as arrival time.
    """
    events = parse_messages(raw, required=required, keep=[arrival] if arrival else [])
    return enrich(events, F.col(arrival) if arrival else None, clamp)


def raw_messages(raw: DataFrame, arrival: Column | None = None) -> DataFrame:
    """The legacy untyped form: message text and arrival time."""
    arrived = F.current_timestamp() if arrival is None else arrival
    return raw.select(F.col("value").cast("string").alias("message"), arrived.alias("event_time"))
