"""Events to Kafka topics, batch or stream. Needs Spark's Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import EVENT_WIRE
from .files import with_trigger

# Producer settings.
PRODUCER = {"kafka.acks": "1", "kafka.retries": "1", "kafka.linger.ms": "10"}


def to_messages(events: DataFrame, key: str | Column | None = None) -> DataFrame:
    """One JSON ``value`` per event (UTF-8, non-ASCII kept) and an optional ``key``.

    ``key`` is a text put on every message, or a column.
    """
    columns = [name for name in EVENT_WIRE.fieldNames() if name in events.columns]
    value = F.to_json(F.struct(*columns)).alias("value")
    if key is None:
        return events.select(value)
    chosen = F.lit(key) if isinstance(key, str) else key
    return events.select(chosen.cast("string").alias("key"), value)


def options(bootstrap: str, topic: str, **extra: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": bootstrap, "topic": topic, **PRODUCER, **extra}


def write_batch(events: DataFrame, bootstrap: str, topic: str, key: str | Column | None = None) -> None:
    to_messages(events, key).write.format("kafka").options(**options(bootstrap, topic)).save()


def write_stream(
    events: DataFrame,
    bootstrap: str,
    topic: str,
    checkpoint: str,
    key: str | Column | None = None,
    trigger: str | None = None,
) -> StreamingQuery:
    writer = to_messages(events, key).writeStream.format("kafka").options(**options(bootstrap, topic))
    return with_trigger(writer.option("checkpointLocation", checkpoint), trigger).start()
