"""Ordered work over keys of any size.

A key such as a camera may hold a large share of all rows, so no key's rows are ever put into one task. Every key is cut into
buckets of its first order column (time, frame number): a plain column, the same for every table size. A bucket is worked
on alone, and what crosses to the next ones is one small row per bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

BUCKET = "_bucket"
SECONDS = 3_600.0  # of a bucket, where the order is a time
NUMBERS = 100_000  # of a bucket, where it is a whole number
ROWS_PER_BLOCK = 10_000  # of consecutive rows that look back only a little
FARTHEST = 1 << 52  # number of the bucket that begins at zero; missing values come before, infinities and NaN after all others


@dataclass(frozen=True)
class Bucketed:
    """``rows`` with a BUCKET column that follows ``order`` within ``keys``."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    span: float | None = None

    @property
    def place(self) -> tuple[str, ...]:
        return (*self.keys, BUCKET)

    def window(self):
        return Window.partitionBy(*self.place).orderBy(*self.order)

    def long_keys(self) -> DataFrame:
        """Keys of several buckets. Only for these does anything cross."""
        reach = self.rows.groupBy(*self.keys).agg(F.min(BUCKET).alias("_low"), F.max(BUCKET).alias("_high"))
        return reach.where("_low < _high").select(*self.keys)

    def long_places(self) -> DataFrame:
        """(keys, BUCKET) of all buckets of these keys; a join with it spreads a key's rows over many tasks."""
        buckets = self.rows.select(*self.place).distinct()
        every = Window.partitionBy(*self.keys)
        reach = buckets.withColumns({"_low": F.min(BUCKET).over(every), "_high": F.max(BUCKET).over(every)})
        return reach.where("_low < _high").select(*self.place)


def bucket_number(column: Column, kind: T.DataType, span: float | None = None) -> Column:
    """The bucket of a time in seconds, a timestamp, a date or a number, never negative; missing values first and NaN last, as they sort."""
    if isinstance(kind, T.IntegralType):
        return F.coalesce(F.floor(column / F.lit(span or NUMBERS)) + FARTHEST, F.lit(0))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        column = column.cast("timestamp").cast("double")
    place = column.cast("double") / F.lit(float(span or SECONDS))
    inside = F.floor(F.greatest(F.least(place, F.lit(float(FARTHEST))), F.lit(float(1 - FARTHEST))))
    return F.when(column.isNull(), F.lit(0)).when(F.isnan(place), F.lit(2 * FARTHEST + 1)).otherwise(inside + FARTHEST)


def bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str], span: float | None = None) -> Bucketed:
    """``order`` should make rows distinct; ``span`` is the width of a bucket in units of its first column."""
    number = bucket_number(F.col(order[0]), df.schema[order[0]].dataType, span)
    return Bucketed(df.withColumn(BUCKET, number.cast("bigint")), tuple(keys), tuple(order), span)


def join_alike(rows: DataFrame, other: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Null-safe equi-join; join columns kept once. Which side is sent where is left to Spark."""
    renamed = other.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in other.columns])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on], F.lit(True))
    return rows.join(renamed, same, how).drop(*[f"_r_{c}" for c in on])


def _carried(parts: Bucketed, summary: Sequence[Column], carry: dict[str, Callable]) -> DataFrame:
    """One row per (key, bucket): each summary folded over the key's earlier buckets."""
    per_bucket = parts.rows.groupBy(*parts.place).agg(*summary)
    before = Window.partitionBy(*parts.keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(*parts.place, *[fold(before).alias(name) for name, fold in carry.items()])


def running_count(parts: Bucketed, name: str) -> DataFrame:
    """1-based row number per key in order."""
    local = parts.rows.withColumn(name, F.row_number().over(parts.window()).cast("bigint"))
    offsets = _carried(parts, [F.count(F.lit(1)).alias("_n")], {"_offset": lambda w: F.sum("_n").over(w)})
    joined = join_alike(local, offsets, parts.place, "left")
    return joined.withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0))).drop("_offset", BUCKET)


def last_known(parts: Bucketed, value: str, name: str) -> DataFrame:
    """The newest non-null ``value`` of the key up to and including each row."""
    running = parts.window().rowsBetween(Window.unboundedPreceding, 0)
    local = parts.rows.withColumn(name, F.last(value, ignorenulls=True).over(running))
    known = F.when(F.col(value).isNotNull(), F.struct(*parts.order))
    newest = F.max_by(F.col(value), known).alias("_newest")
    carried = _carried(parts, [newest], {"_before": lambda w: F.last("_newest", ignorenulls=True).over(w)})
    joined = join_alike(local, carried, parts.place, "left")
    return joined.withColumn(name, F.coalesce(name, "_before")).drop("_before", BUCKET)


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: int,
    results: dict[str, Callable],
    span: float | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Windows over the last ``size`` rows of a key, current row included.

    ``results`` maps a new column to a function of the window. The rows of a key are numbered and cut into blocks
    of consecutive ones; the last ``size`` - 1 rows of a block are also given to the next one as context and
    dropped again afterwards.
    """
    length = max(rows_per_block, size)
    numbered = running_count(bucketed(df, keys, order, span), "_n").withColumn("_block", F.expr(f"(_n - 1) div {length}"))
    tail = (F.col("_n") - 1) % length >= length - (size - 1)
    homes = F.when(tail, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array("_block"))
    spread = numbered.withColumn("_home", F.explode(homes))
    frame = Window.partitionBy(*keys, "_home").orderBy("_n").rowsBetween(-(size - 1), 0)
    done = spread.withColumns({name: make(frame) for name, make in results.items()})
    return done.where(F.col("_home") == F.col("_block")).drop("_n", "_block", "_home")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """1-based row number of a whole table in the order of any columns.

    Spark's range partitions are written once with each row's partition and place; the rows before a partition are added
    up from one count per partition.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(ranges, "ranges").withColumn("_part", F.shiftright("_at", 33))
    before, total = [], 0
    for part, size in sorted(tuple(r) for r in rows.groupBy("_part").count().collect()):  # one row per partition
        before.append((part, total))
        total += size
    offsets = df.sparkSession.createDataFrame(before, "_part bigint, _offset bigint")
    place = F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, place).drop("_part", "_at", "_offset")
