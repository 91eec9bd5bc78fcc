"""Folds on streams: the rules of ``operators.folds`` with the state in Spark's state store."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Fold, _runs, _to_arrow, _to_values

STATE = T.StructType([T.StructField("body", T.StringType())])
LATE = T.StructField("late", T.BooleanType())
PACK = "_pack"  # many rows of one key as one Arrow message
PACKED_ROWS = 20_000  # at most, of what a fold gives back; packs are dealt to all tasks, however few keys there are


class Forget(NamedTuple):
    """Drop a key's state once the watermark is ``after_ms`` past the key's newest row.

    ``event_time`` is the timestamp column the stream has its watermark on. Spark leaves out
    rows that are behind the watermark, so its delay must cover how late rows may come.
    """

    event_time: str
    after_ms: int


def fold_stream(rows: DataFrame, fold: Fold, forget: Forget | None = None) -> DataFrame:
    """``rows`` with the fold's outputs and ``late``.

    A micro-batch's rows of a key are put in order before they meet the state, so the result
    does not depend on how a batch was read. A row older than the newest row the state has
    seen does not rewind it: it comes out with ``late`` set and null outputs. Bound the rows
    of a trigger (``maxOffsetsPerTrigger``, ``maxFilesPerTrigger``) to bound what is held
    of one key at a time. ``forget`` drops the state of keys that end for good, such as
    face tracks; without it every key's state is kept.

    Rows meet the state packed, many to one Arrow message, as Spark and its Python serializer do much work for each row
    of a keyed state. With ``forget`` they go one by one, since Spark must see each row's time.
    """
    schema = T.StructType([*rows.schema.fields, *fold.outputs.fields, LATE])
    columns, outputs = rows.columns, fold.outputs.fieldNames()
    order, needed = list(fold.order), fold.needed

    def advance(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [batch for batch in batches if len(batch)]
        if not parts:
            return
        body = json.loads(state.get[0]) if state.exists else {"fold": fold.start(), "newest": None}
        given = (pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]).sort_values(order, kind="stable", na_position="first")
        given = given.reset_index(drop=True)
        newest = body["newest"]
        late = _older([given[name].to_numpy() for name in order], newest)
        timely = given[~late]
        made = pd.DataFrame(None, index=given.index, columns=outputs, dtype=object)
        if len(timely):
            after, out = fold.run(body["fold"], {name: _values(timely[name]) for name in needed}, len(timely))
            for name in outputs:
                filled = pd.Series(list(out[name]), index=timely.index, dtype=object)
                made[name] = filled.reindex(given.index)
            last = [value.item() if hasattr(value, "item") else value for value in timely[order].iloc[-1]]
            state.update((json.dumps({"fold": after, "newest": last}),))
        newest_ms = int(given[forget.event_time].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest_ms, state.getCurrentWatermarkMs()) + forget.after_ms)
        given[outputs] = made
        given[LATE.name] = late
        yield given[[*columns, *outputs, LATE.name]].astype({name: object for name in outputs})

    if forget is None:
        folded = _fold_packed(rows, fold, schema)
    else:
        folded = rows.groupBy(*fold.keys).applyInPandasWithState(advance, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return folded.withColumn(LATE.name, F.coalesce(LATE.name, F.lit(False)))  # a partitioned sink can't take Python's rows as they are


def _fold_packed(rows: DataFrame, fold: Fold, schema: T.StructType) -> DataFrame:
    given, made = to_arrow_schema(rows.schema), to_arrow_schema(schema)
    keys, order, needed, outputs = list(fold.keys), list(fold.order), fold.needed, fold.outputs.fieldNames()
    key_schema = T.StructType([rows.schema[name] for name in keys])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(field.name).cast(field.type) for field in given], schema=given)
            if keys:
                codes = pa.table({name: batch.column(name).dictionary_encode().indices for name in keys})
                batch = batch.take(pc.sort_indices(codes, [(name, "ascending") for name in keys]))
            runs = _runs([batch.column(name) for name in keys], batch.num_rows)
            first = pa.array([begin for begin, _ in runs], pa.int64())
            packs = pa.array([batch.slice(begin, end - begin).serialize().to_pybytes() for begin, end in runs], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(name).take(first) for name in keys), packs], [*keys, PACK])

    def advance(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batches = [pa.ipc.read_record_batch(pa.py_buffer(told), given) for frame in frames for told in frame[PACK]]
        if not batches:
            return
        body = json.loads(state.get[0]) if state.exists else {"fold": fold.start(), "newest": None}
        rows = _in_order(pa.Table.from_batches(batches).combine_chunks().to_batches()[0], order)
        late = _older([_to_values(rows.column(name)) for name in order], body["newest"])
        timely = rows.filter(pa.array(~late)) if late.any() else rows
        added = {name: pa.nulls(len(late), made.field(name).type) for name in outputs}
        if timely.num_rows:
            columns = {name: _to_values(timely.column(name)) for name in needed}
            after, out = fold.run(body["fold"], columns, timely.num_rows)
            added = {name: _to_arrow([out[name]], made.field(name).type) for name in outputs}
            if late.any():
                place = pa.array(np.cumsum(~late) - 1, mask=late)
                added = {name: values.take(place) for name, values in added.items()}
            state.update((json.dumps({"fold": after, "newest": [columns[name][-1:].tolist()[0] for name in order]}),))
        carried = [rows.column(name).cast(made.field(name).type) for name in given.names]
        done = pa.RecordBatch.from_arrays([*map(_without_nan, [*carried, *added.values()]), pa.array(late)], schema=made)
        yield pd.DataFrame({PACK: [done.slice(at, PACKED_ROWS).serialize().to_pybytes() for at in range(0, done.num_rows, PACKED_ROWS)]})

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for told in batch.column(PACK):
                yield pa.ipc.read_record_batch(told.as_buffer(), made)

    packed = rows.mapInArrow(pack, T.StructType([*key_schema.fields, T.StructField(PACK, T.BinaryType())]))
    folded = packed.groupBy(*keys).applyInPandasWithState(advance, f"{PACK} binary", STATE, "append", GroupStateTimeout.NoTimeout)
    dealt = folded.withColumn(PACK, F.coalesce(PACK, F.lit(b""))).repartition(rows.sparkSession.sparkContext.defaultParallelism)  # Python's rows can't be dealt as they are
    return dealt.mapInArrow(unpack, schema)


def _in_order(rows: pa.RecordBatch, order: list[str]) -> pa.RecordBatch:
    """Rows sorted by ``order``; null and NaN alike come first, equal rows stay as they are."""
    columns = pa.table({name: pa.array(_to_values(rows.column(name)), from_pandas=True) for name in order})
    return rows.take(pc.sort_indices(columns, [(name, "ascending") for name in order], null_placement="at_start"))


def _without_nan(column: pa.Array) -> pa.Array:
    """NaN is written as null, as by Spark's way over pandas."""
    if not pa.types.is_floating(column.type):
        return column
    return pc.if_else(pc.is_nan(column), pa.scalar(None, column.type), column)


def _older(columns: list[np.ndarray], newest: list | None) -> np.ndarray:
    """Which rows come before ``newest``, by the first column in which they differ from it."""
    late, open_ = np.zeros(len(columns[0]), dtype=bool), np.full(len(columns[0]), newest is not None)
    for mine, theirs in zip(columns, newest or []):
        differs = np.flatnonzero(open_)
        differs = differs[np.asarray(mine[differs] != theirs, dtype=bool)]
        late[differs] = np.asarray(mine[differs] < theirs, dtype=bool)
        open_[differs] = False
    return late


def _values(column: pd.Series):
    first = column.iloc[0]
    if isinstance(first, (list, np.ndarray)):
        return np.stack([np.asarray(v, dtype="float64") for v in column])
    return column.to_numpy()


def timely(folded: DataFrame) -> DataFrame:
    """Rows that came in order, without the marker."""
    return folded.where("not late").drop(LATE.name)


def late_rows(folded: DataFrame) -> DataFrame:
    """Rows that came too late for their key's state, without the fold's outputs to rely on. Write a folded stream with the marker
    as a partition and both kinds are kept: the late ones beside the result, to be counted or sent again."""
    return folded.where("late").drop(LATE.name)
