"""Questions asked of stored events: filters, KPIs, latest events, distribution, timelines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, times
from ..operators.quantiles import percentiles

# Candidate order, shown columns and the report's defaults.
TIME_CANDIDATES = ("event_ts", "spark_ts", "event_time_dt", "event_time", "producer_ts")
SHOWN = (
    "event_time_dt",
    "event_ts",
    "spark_ts",
    "producer_ts",
    "source_id",
    "frame_id",
    "face_id",
    "emotion",
    "score",
    "e2e_latency_ms",
)
ALL_SOURCES = "ALL"
LATEST_ROWS = 200
WINDOW_MINUTES = 60
MIN_SCORE = 0.5


@dataclass(frozen=True)
class BaseTime:
    """The column time operations use, its expression and its newest value."""

    name: str
    column: Column
    newest_us: int  # microseconds since 1970 in UTC, whatever the driver's own time zone is

    @property
    def newest(self) -> dt.datetime:
        """As a UTC time without zone."""
        return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=self.newest_us)


def normalise(events: DataFrame) -> DataFrame:
    """Add ``event_time_dt`` where ``event_time`` exists; time columns become UTC timestamps."""
    changes = {}
    if "event_time" in events.columns and "event_time_dt" not in events.columns:
        changes["event_time_dt"] = _as_time(events, "event_time")
    for name in ("event_ts", "spark_ts", "event_time_dt"):
        if name in events.columns and not isinstance(events.schema[name].dataType, T.TimestampType):
            changes[name] = _as_time(events, name)
    return events.withColumns(changes) if changes else events


def _as_time(events: DataFrame, name: str) -> Column:
    dtype = events.schema[name].dataType
    return F.col(name) if isinstance(dtype, T.TimestampType) else times.coerce_timestamp(F.col(name), dtype)


def time_counts(events: DataFrame) -> DataFrame:
    """One row: non-null count and newest value of every time candidate present."""
    present = [name for name in TIME_CANDIDATES if name in events.columns]
    sums = []
    for name in present:
        sums += [F.count(_as_time(events, name)).alias(f"{name}_rows"), F.max(_as_time(events, name)).alias(f"{name}_newest")]
    return events.agg(*sums)


def choose_time(events: DataFrame, date_column: str | None = None) -> BaseTime | None:
    """The first candidate that exists and is not entirely null.

    ``date_column`` names a partition column holding the date of ``event_ts``: then only the
    newest date is scanned for the newest event.
    """
    if date_column and date_column in events.columns and "event_ts" in events.columns:
        newest_date = events.agg(F.max(date_column)).first()[0]
        if newest_date is not None:
            newest = events.where(F.col(date_column) == F.lit(newest_date)).agg(F.unix_micros(F.max(_as_time(events, "event_ts")))).first()[0]
            if newest is not None:
                return BaseTime("event_ts", _as_time(events, "event_ts"), newest)
    present = [name for name in TIME_CANDIDATES if name in events.columns]
    if not present:
        return None
    counts = time_counts(events)
    found = counts.select(*[F.unix_micros(c).alias(c) if c.endswith("_newest") else F.col(c) for c in counts.columns]).first()
    for name in present:
        if found[f"{name}_rows"] > 0:
            return BaseTime(name, _as_time(events, name), found[f"{name}_newest"])
    return None


def recent(
    events: DataFrame,
    minutes: int = WINDOW_MINUTES,
    base: BaseTime | None = None,
    date_column: str | None = None,
) -> DataFrame:
    """The last ``minutes`` before the newest event of the data, both ends included.

    The bound is a literal, so it reaches the Parquet scan; with ``date_column`` it also
    prunes partitions. Without a base time nothing is filtered.
    """
    base = base or choose_time(events, date_column)
    if base is None:
        return events
    start = F.timestamp_micros(F.lit(base.newest_us - minutes * 60_000_000))
    kept = events.where(base.column >= start)
    if date_column and base.name == "event_ts" and date_column in events.columns:
        kept = kept.where(F.col(date_column) >= F.to_date(start))
    return kept


def recent_by_clock(events: DataFrame, minutes: int, time: Column, now: Column | None = None) -> DataFrame:
    """The last ``minutes`` before ``now``, by default the wall clock."""
    current = F.current_timestamp() if now is None else now
    return events.where(time >= current - F.make_interval(mins=F.lit(minutes)))


def min_score(events: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """Score at least ``least``; a missing or unreadable score counts as 0."""
    if "score" not in events.columns:
        return events
    score = F.col("score")
    if not isinstance(events.schema["score"].dataType, T.DoubleType):
        score = score.try_cast("double")
    enough = (score >= F.lit(float(least))) & ~F.isnan(score)
    if least <= 0:
        enough = enough | score.isNull() | F.isnan(score)
    return events.where(enough)


def from_source(events: DataFrame, source: str = ALL_SOURCES) -> DataFrame:
    if source == ALL_SOURCES or "source_id" not in events.columns:
        return events
    return events.where(F.col("source_id") == F.lit(source))


def filtered(
    events: DataFrame,
    minutes: int = WINDOW_MINUTES,
    least_score: float = MIN_SCORE,
    source: str = ALL_SOURCES,
    date_column: str | None = None,
) -> DataFrame:
    """Time window, then score, then source. The window is anchored on the newest event of
    any source and any score."""
    return from_source(min_score(recent(events, minutes, date_column=date_column), least_score), source)


def sources(events: DataFrame) -> DataFrame:
    return events.select("source_id").where(F.col("source_id").isNotNull()).distinct().orderBy("source_id")


def kpis(events: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: event count, p50 and p95 of latency and processing time, and their texts."""
    measures = {"latency": "e2e_latency_ms", "processing": "processing_time_ms"}
    values = {
        label: times.number(F.col(name)) if name in events.columns else F.lit(None).cast("double")
        for label, name in measures.items()
    }
    if approximate:
        sketches = [F.percentile_approx(value, [0.5, 0.95], 10_000).alias(label) for label, value in values.items()]
        row = events.agg(F.count(F.lit(1)), *sketches).first()
        rows, found = row[0], {label: row[label] or [None, None] for label in values}
    else:
        rows, found = percentiles(events, values, (0.5, 0.95))
    numbers = {f"{label}_{rank}": at for label, pair in found.items() for rank, at in zip(("p50", "p95"), pair)}
    result = events.sparkSession.range(1).select(
        F.lit(rows).cast("bigint").alias("events"), *[F.lit(at).cast("double").alias(n) for n, at in numbers.items()]
    )
    return result.withColumns({f"{name}_text": text.kpi_text(F.col(name)) for name in numbers})


def shown_columns(events: DataFrame) -> DataFrame:
    return events.select(*[name for name in SHOWN if name in events.columns])


def latest(events: DataFrame, rows: int = LATEST_ROWS, base: BaseTime | None = None) -> DataFrame:
    """The newest ``rows`` events, ties by frame and face; without a base time any ``rows``."""
    base = base or choose_time(events)
    if base is not None:
        ties = [F.col(name) for name in ("frame_id", "face_id") if name in events.columns]
        events = events.orderBy(base.column.desc_nulls_last(), *ties)
    return shown_columns(events.limit(rows))


def last_arrived(events: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` events that arrived last."""
    ties = [F.desc(name) for name in ("frame_id", "face_id") if name in events.columns]
    return events.orderBy(F.desc("spark_ts"), *ties).limit(rows)


def distribution(events: DataFrame, legacy_case: bool = False) -> DataFrame:
    """Events per label, most frequent first. Events without a label are not counted."""
    label = F.col("emotion") if legacy_case else text.fold_case(F.col("emotion"))
    counted = events.where(F.col("emotion").isNotNull()).groupBy(label.alias("emotion")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "emotion")


def top_values(events: DataFrame, column: str, rows: int = 20) -> DataFrame:
    """The most frequent values of a column."""
    counted = events.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), column).limit(rows)


def timeline(
    events: DataFrame, time: Column, step_seconds: int = 60, legacy_case: bool = False
) -> DataFrame:
    """Events per (slot, label). Rows without time or label are left out.

    ``legacy_case`` counts before lower-casing, so labels differing in case stay apart.
    """
    slot = times.floor_minute(time) if step_seconds == 60 else times.floor_seconds(time, step_seconds)
    complete = events.where(time.isNotNull() & F.col("emotion").isNotNull())
    label = F.col("emotion") if legacy_case else text.fold_case(F.col("emotion"))
    name = "minute" if step_seconds == 60 else "slot"
    counted = complete.groupBy(slot.alias(name), label.alias("emotion")).agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("emotion", text.fold_case(F.col("emotion"))) if legacy_case else counted


def timeline_pivot(events: DataFrame, time: Column, labels: Sequence[str] | None = None) -> DataFrame:
    """One row per minute, one column per label, 0 where a label is absent.

    The columns are the labels of the data (one more pass over it) unless the caller names them.
    """
    label = text.fold_case(F.col("emotion"))
    complete = events.where(time.isNotNull() & F.col("emotion").isNotNull())
    if labels is None:
        labels = sorted(row[0] for row in complete.select(label).distinct().collect())
    counts = [F.count_if(label == F.lit(name)).alias(name) for name in labels]
    minutes = complete.groupBy(times.floor_minute(time).alias("minute"))
    return (minutes.agg(*counts) if counts else minutes.agg(F.count(F.lit(1)).alias("n")).drop("n")).orderBy("minute")


def frame_rate(frames: DataFrame, time: Column) -> DataFrame:
    """Frames per second of each source, over aligned one-second spans."""
    span = F.window(time, "1 second")["start"].alias("second")
    return frames.groupBy("source_id", span).agg((F.count(F.lit(1)) / F.lit(1.0)).alias("fps"))
