"""Event store, label files and console as sinks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

# Fixed value: the default trigger.
DEFAULT_TRIGGER = "5 seconds"

SPLIT = {"parquet.block.size": 2 << 20, "compression": "none"}  # so that several tasks can read one file of a stream


def with_trigger(writer: DataStreamWriter, trigger: str | None) -> DataStreamWriter:
    """``trigger`` is an interval such as "5 seconds", or "available-now" for one bounded run."""
    if trigger == "available-now":
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger or DEFAULT_TRIGGER)


def append_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    trigger: str | None = None,
    partition_by: str | None = "event_date",
    name: str | None = None,
) -> StreamingQuery:
    """Append a stream to a Parquet folder, each row once even across restarts."""
    writer = events.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if name:
        writer = writer.queryName(name)
    return with_trigger(writer, trigger).start()


def append_to_both(
    events: DataFrame, first: tuple[str, str], second: tuple[str, str], trigger: str | None = None
) -> list[StreamingQuery]:
    """One stream into two folders, each (path, checkpoint) progressing on its own."""
    return [append_stream(events, path, mark, trigger, partition_by=None) for path, mark in (first, second)]


def print_stream(events: DataFrame, checkpoint: str | None = None, trigger: str | None = None) -> StreamingQuery:
    writer = events.writeStream.format("console").outputMode("append").option("truncate", False)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return with_trigger(writer, trigger).start()


def append_in_turn(parts: list[DataFrame], path: str) -> None:
    """Append ``parts`` to ``path``, one file per partition, as a stream is to read them: in the order of their partitions.

    A stream reads files in the order of their times. A part's files are written at once, then the times are set, a second apart;
    only names and times pass through the driver. A store that keeps no set times gets the files one after the other.
    """
    spark = parts[0].sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = _data_files(store, place) if store.exists(place) else {}
    names: list[str] = []
    for part in parts:
        part.write.mode("append").options(**SPLIT).parquet(path)
        new = _data_files(store, place).keys() - before.keys() - set(names)
        names += sorted(new, key=lambda name: int(name.split("-")[1]))  # part-<partition>-...
    newest = max([int(time.time() * 1000) - 1000 * len(names), *before.values()])
    for number, name in enumerate(names, 1):
        store.setTimes(place.suffix(f"/{name}"), newest + 1000 * number, -1)
    times = _data_files(store, place)
    moments = [newest, *(times[name] for name in names)]
    if any(later <= earlier for earlier, later in zip(moments, moments[1:])):
        for name in names:
            spark.read.schema(parts[0].schema).parquet(f"{path}/{name}").coalesce(1).write.mode("append").parquet(path)
            store.delete(place.suffix(f"/{name}"), False)


def _data_files(store, place) -> dict[str, int]:
    """Names and times of a folder's Parquet files."""
    return {s.getPath().getName(): s.getModificationTime() for s in store.listStatus(place) if s.getPath().getName().startswith("part-")}


def compact_dates(events: DataFrame, path: str, rows_per_file: int) -> None:
    """Rewrite ``events`` as fewer files under a new ``path``, keeping the date partitions.

    The rebalance hint merges small dates and splits a date that holds most of the rows.
    """
    writer = events.hint("rebalance", "event_date").write
    writer.option("maxRecordsPerFile", rows_per_file).partitionBy("event_date").parquet(path)


def write_labels(labels: DataFrame, json_path: str, text_path: str) -> None:
    """The class list as JSON lines and as plain text, both in class order.

    A label table holds one row per class of a model, so one file each is enough.
    """
    ordered = labels.coalesce(1).sortWithinPartitions("idx")
    ordered.write.json(json_path)
    ordered.select("label").write.text(text_path)
