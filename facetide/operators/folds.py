"""Ordered folds: a state walks over a key's rows in order and labels each of them.

The same ``Fold`` runs over a table (here) and over a stream (``streaming.stateful``).

Over a table every bucket of ``operators.ordered`` is folded on its own, from the state the buckets before it lead to. To
know that state a fold sums up each bucket in a small body that holds for every state the bucket can be entered with,
and bodies of neighbouring buckets compose to one: an average is an affine map, a vote the newest labels, a label switch and a
rate limit are small tables of entries and exits. ``before`` composes them in Spark. What a bucket starts from
then travels to its rows as a head row of its own, sorted in front of them.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import stored
from .ordered import BUCKET, Bucketed, bucketed, join_alike

State = dict[str, Any]
Columns = dict[str, Any]
Body = Any  # a JSON value

HEAD = "_head"  # JSON of what a bucket is entered with; null in the rows themselves
BODY = "_body"
BLOCK = "_block"
FAN = 256  # buckets composed by one task at once


class Fold(ABC):
    """Rules of one fold. A state is a JSON object."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    inputs: tuple[str, ...]
    outputs: T.StructType

    @abstractmethod
    def start(self) -> State:
        """The state before a key's first row."""

    @abstractmethod
    def run(self, state: State, rows: Columns, size: int) -> tuple[State, Columns]:
        """Walk over ``size`` rows (columns as arrays) and return the state and the outputs."""

    @abstractmethod
    def heads(self, parts: Bucketed) -> DataFrame:
        """(keys, BUCKET, HEAD): what the buckets before lead to, in one or several rows."""

    @abstractmethod
    def enter(self, state: State, head: Body) -> State:
        """``state`` with what a head row tells."""

    @property
    def needed(self) -> list[str]:
        return list(dict.fromkeys([*self.order, *self.inputs]))


def fold_table(df: DataFrame, fold: Fold, span: float | None = None) -> DataFrame:
    """``df`` with the fold's output columns. All rows are kept. ``df`` is read several times, so it should be
    a stored table or cheap to compute."""
    parts = bucketed(df, fold.keys, fold.order, span)
    long = stored(parts.long_places(), "places")
    entered = None
    if not long.isEmpty():
        rows = join_alike(parts.rows.select(*dict.fromkeys([*parts.place, *fold.needed])), long, parts.place, "left_semi") if parts.keys else parts.rows
        entered = fold.heads(replace(parts, rows=rows))
    schema = T.StructType([*df.schema.fields, *fold.outputs.fields])
    arrow_schema = to_arrow_schema(schema)
    carried, outputs = df.columns, fold.outputs.fields
    keys, needed = parts.keys, fold.needed

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state = None, None
        for batch in batches:
            made: dict[str, list] = {field.name: [] for field in outputs}
            rows, columns = _opened(batch, needed)
            for here, _, head, begin, end in _stretches(batch, [*keys, BUCKET]):
                if here != place:
                    place, state = here, fold.start()
                for body in head:
                    state = fold.enter(state, body)
                if end > begin:
                    state, out = fold.run(state, {k: v[begin:end] for k, v in columns.items()}, end - begin)
                    for name, part in out.items():
                        made[name].append(part)
            kept = [rows.column(name).cast(arrow_schema.field(name).type) for name in carried]
            added = [_to_arrow(made[f.name], arrow_schema.field(f.name).type) for f in outputs]
            yield pa.RecordBatch.from_arrays([*kept, *added], schema=arrow_schema)

    return laid_out(parts, entered).mapInArrow(label, schema)


def laid_out(parts: Bucketed, entered: DataFrame | None = None) -> DataFrame:
    """Each bucket in order inside one partition, its head rows first."""
    rows = parts.rows.withColumn(HEAD, F.lit(None).cast("string"))
    if entered is not None:
        rows = rows.unionByName(entered.select(*parts.place, HEAD), allowMissingColumns=True)
    # As many tasks as the session has shuffle partitions: little data can still be much work in Python.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *parts.place).sortWithinPartitions(*parts.place, F.col(HEAD).isNull(), *parts.order)


def bodies(parts: Bucketed, fold: Fold, sum_up: Callable[[State, Columns, int], tuple[State, Body]], compose: Callable[[Body, Body], Body], entered: DataFrame | None = None) -> DataFrame:
    """(keys, BUCKET, BODY): one body per bucket, whose rows may come in several stretches."""
    keys, needed = [*parts.keys, BUCKET], fold.needed

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state, row, body, some = None, None, None, None, False
        for batch in batches:
            done = []
            columns = _opened(batch, needed)[1]
            for here, at, head, begin, end in _stretches(batch, keys):
                if here != place:
                    if some:
                        done.append((row, body))
                    place, state, row, some = here, fold.start(), batch.select(keys).slice(at, 1), False
                for told in head:
                    state = fold.enter(state, told)
                if end > begin:
                    state, more = sum_up(state, {k: v[begin:end] for k, v in columns.items()}, end - begin)
                    body, some = (compose(body, more) if some else more), True
            yield from _as_rows(done)
        yield from _as_rows([(row, body)] if some else [])

    schema = T.StructType([*(parts.rows.schema[k] for k in keys), T.StructField(BODY, T.StringType())])
    return laid_out(parts, entered).mapInArrow(work, schema)


def _as_rows(done: list[tuple[pa.RecordBatch, Body]], name: str = BODY) -> Iterator[pa.RecordBatch]:
    if done:
        table = pa.Table.from_batches([row for row, _ in done]).combine_chunks()
        yield from table.append_column(name, pa.array([json.dumps(body) for _, body in done], pa.string())).to_batches()


def before(table: DataFrame, keys: Sequence[str], compose: Callable[[Body, Body], Body]) -> DataFrame:
    """(keys, BUCKET, HEAD) of every bucket but a key's first: the bodies of all earlier buckets, composed.

    Blocks of FAN bucket numbers are composed each by one task, then blocks of blocks, until each key has one; on the
    way back a block's buckets start from what is before the block. So no task composes more than FAN bodies of a key.
    """
    table = stored(table, "bodies")
    block = F.expr(f"{BUCKET} div {FAN}")
    reach = table.groupBy(*keys).agg((F.max(block) - F.min(block)).alias("_blocks"))
    if reach.where("_blocks > 0").isEmpty():
        return running(table, keys, compose)
    blocks = table.withColumn(BLOCK, block)
    totals = running(blocks, [*keys, BLOCK], compose, totals=True).drop(BUCKET).withColumnRenamed(BLOCK, BUCKET)
    outer = before(totals, keys, compose).withColumnRenamed(BUCKET, BLOCK)
    return running(blocks, [*keys, BLOCK], compose, outer).drop(BLOCK)


def running(table: DataFrame, by: Sequence[str], step: Callable[[Body, Body], Body], entered: DataFrame | None = None, totals: bool = False) -> DataFrame:
    """For each row of (``by``, BUCKET, BODY) the bodies before it in its group, composed (HEAD); with ``totals`` one
    row per group with all of them (BODY). ``entered`` gives what is before a group. Rows stream through, none are gathered."""
    rows = table.withColumn(HEAD, F.lit(None).cast("string"))
    if entered is not None:
        rows = rows.unionByName(entered, allowMissingColumns=True)
    columns = list(dict.fromkeys([*by, BUCKET]))
    in_order = rows.repartition(*by) if by else rows.repartition(1)
    in_order = in_order.sortWithinPartitions(*by, F.col(HEAD).isNull(), BUCKET).select(*columns, HEAD, BODY)
    by = list(by)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, body, some, last = None, None, False, None
        for batch in batches:
            names = [batch.column(k) for k in by]
            heads, given = batch.column(HEAD), batch.column(BODY)
            done = []
            for begin, end in _runs(names, batch.num_rows):
                here = tuple(k[begin].as_py() for k in names)
                if here != group:
                    if totals and some:
                        done.append((last, body))
                    group, some = here, False
                for i in range(begin, end):
                    row = batch.select(columns).slice(i, 1)
                    if heads[i].is_valid:
                        body, some = json.loads(heads[i].as_py()), True
                        continue
                    if some and not totals:
                        done.append((row, body))
                    more = json.loads(given[i].as_py())
                    body, some, last = (step(body, more) if some else more), True, row
            yield from _as_rows(done, BODY if totals else HEAD)
        yield from _as_rows([(last, body)] if totals and some else [])

    schema = T.StructType([*(rows.schema[k] for k in columns), T.StructField(BODY if totals else HEAD, T.StringType())])
    return in_order.mapInArrow(work, schema)


def _opened(batch: pa.RecordBatch, needed: list[str]) -> tuple[pa.RecordBatch, Columns]:
    """The rows without head rows, and their columns as arrays."""
    rows = batch.filter(pc.is_null(batch.column(HEAD)))
    return rows, {name: _to_values(rows.column(name)) for name in needed}


def _stretches(batch: pa.RecordBatch, place: list[str]) -> Iterator[tuple[tuple, int, list[Body], int, int]]:
    """Stretches of one place in a sorted batch: the place, where it begins in the batch, its heads, and its rows
    [begin, end) among the rows without heads."""
    columns = [batch.column(name) for name in place]
    heads = batch.column(HEAD)
    is_head = heads.is_valid().to_numpy(zero_copy_only=False)
    rows_before = np.concatenate([[0], np.cumsum(~is_head)])
    for begin, end in _runs(columns, batch.num_rows):
        told = [json.loads(heads[i].as_py()) for i in (begin + np.flatnonzero(is_head[begin:end])).tolist()]
        yield tuple(c[begin].as_py() for c in columns), begin, told, int(rows_before[begin]), int(rows_before[end])


def _runs(columns: list[pa.Array], size: int) -> list[tuple[int, int]]:
    """Stretches of consecutive rows with equal key columns."""
    if not size:
        return []
    change = np.zeros(size, dtype=bool)
    change[0] = True
    for column in columns:
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    begins = np.flatnonzero(change).tolist()
    return list(zip(begins, [*begins[1:], size]))


def _to_values(column: pa.Array):
    """Arrow column as a numpy array; arrays of equal length as a matrix."""
    if pa.types.is_timestamp(column.type):
        return column.cast(pa.int64()).to_numpy(zero_copy_only=False)
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        lengths = column.value_lengths().unique()
        if column.null_count == 0 and len(lengths) == 1:
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), lengths[0].as_py())
        raise ValueError("vectors must be non-null and of one length")
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array([*column.to_pylist(), None], dtype=object)[:-1]
    return column.to_numpy(zero_copy_only=False)


def _to_arrow(parts: list, kind: pa.DataType) -> pa.Array:
    if parts and all(isinstance(part, np.ndarray) for part in parts):
        if parts[0].ndim == 2:  # one vector per row
            values = np.concatenate(parts)
            offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel())).cast(kind)
        return pa.array(np.concatenate(parts)).cast(kind)
    return pa.array([value for part in parts for value in part], type=kind)
