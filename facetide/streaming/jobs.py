"""Streaming queries: ingest, live timeline, live rate, and waiting for them."""

from __future__ import annotations

import threading

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..config import IngestSettings
from ..functions import text
from ..plans import ingest
from ..session import fresh_folder
from ..sinks.files import append_stream, with_trigger
from ..sources import kafka

VERSION = "_batch"


def start_ingest(spark: SparkSession, settings: IngestSettings = IngestSettings()) -> StreamingQuery:
    """Kafka topic to the date-partitioned event store."""
    raw = kafka.read_stream(
        spark,
        settings.bootstrap,
        settings.topic,
        starting_offsets=settings.starting_offsets,
        fail_on_data_loss=settings.fail_on_data_loss,
        max_offsets_per_trigger=settings.max_offsets_per_trigger,
    )
    return append_stream(ingest.ingest(raw), settings.out_path, settings.checkpoint_path, settings.trigger)


def live_timeline(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Events per (minute, label) of a stream; event time is ``event_ts``."""
    slots = events.withWatermark("event_ts", watermark).where(F.col("emotion").isNotNull())
    counted = slots.groupBy(F.window("event_ts", "1 minute").alias("_slot"), text.fold_case(F.col("emotion")).alias("emotion"))
    return counted.agg(F.count(F.lit(1)).alias("count")).select(F.col("_slot.start").alias("minute"), "emotion", "count")


def live_rate(frames: DataFrame, time: str = "ts", watermark: str = "10 seconds") -> DataFrame:
    """Frames per second of each source of a stream."""
    spans = frames.withWatermark(time, watermark).groupBy("source_id", F.window(time, "1 second").alias("_span"))
    return spans.agg((F.count(F.lit(1)) / F.lit(1.0)).alias("fps")).select("source_id", F.col("_span.start").alias("second"), "fps")


def keep_updates(counts: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Write changed rows of a live aggregate to ``path``, marked with their micro-batch.

    A batch that is repeated after a failure replaces its own folder, so nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{VERSION}={number}")

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return with_trigger(writer, trigger).start()


def current_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of every row written by ``keep_updates``."""
    versions = spark.read.option("basePath", path).parquet(path)
    rest = [name for name in versions.columns if name not in (*keys, VERSION)]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), VERSION).alias("_row"))
    return newest.select(*keys, "_row.*")


def run_to_end(rows: DataFrame, purpose: str, partition_by: str | None = None) -> DataFrame:
    """Run a stream over all it has now into a new folder and read that folder."""
    spark = rows.sparkSession
    path, mark = fresh_folder(spark, purpose), fresh_folder(spark, f"{purpose}-progress")
    append_stream(rows, path, mark, "available-now", partition_by).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def wait_for_any(spark: SparkSession) -> None:
    """Return, or raise its error, as soon as any running query ends."""
    spark.streams.awaitAnyTermination()


class Accounts(StreamingQueryListener):
    """Books of one query: per micro-batch the rows that came in, the watermark, and what was dropped behind it.

    Rows that came in are counted by ``counted_input``. An aggregate meets the watermark after its rows are summed up per
    group, so ``dropped`` counts groups there, and rows in keyed state.
    """

    ROWS = "rows_in"

    def __init__(self):
        self.batches: dict[int, tuple[int, str | None, int]] = {}
        self.ended = threading.Event()
        self.error: str | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(self.ROWS)
        dropped = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        rows, mark, before = self.batches.get(progress.batchId, (0, None, 0))
        self.batches[progress.batchId] = (max(rows, seen["n"] if seen else 0), progress.eventTime.get("watermark", mark), max(before, dropped))

    def onQueryTerminated(self, event) -> None:
        self.error = event.exception
        self.ended.set()


def counted_input(rows: DataFrame) -> DataFrame:
    """``rows`` whose number is told to ``Accounts``."""
    return rows.observe(Accounts.ROWS, F.count(F.lit(1)).alias("n"))


def accounted(spark: SparkSession, start, seconds: float = 60.0) -> DataFrame:
    """Run the query that ``start()`` starts to its end; (batch, rows_in, watermark, dropped) of its micro-batches."""
    books = Accounts()
    spark.streams.addListener(books)
    try:
        start().awaitTermination()
        if not books.ended.wait(seconds):
            raise TimeoutError("the query's last progress did not arrive")
    finally:
        spark.streams.removeListener(books)
    rows = [(number, *told) for number, told in sorted(books.batches.items())]
    return spark.createDataFrame(rows, "batch long, rows_in long, watermark string, dropped long")


def supervise(queries: dict[str, StreamingQuery], poll_seconds: float = 0.2) -> list[tuple[str, str, str | None]]:
    """Wait until all queries end, or one fails: then the others are stopped at once.

    One (name, outcome, error) per query; outcomes are "finished", "failed" and "stopped".
    """
    errors: dict[str, str] = {}
    running = dict(queries)
    while running and not errors:
        for name, query in list(running.items()):
            try:
                if query.awaitTermination(poll_seconds):
                    del running[name]
            except StreamingQueryException as error:
                errors[name] = str(error)
                del running[name]
    for query in running.values():
        query.stop()
    return [(name, "failed" if name in errors else "stopped" if name in running else "finished", errors.get(name)) for name in queries]
