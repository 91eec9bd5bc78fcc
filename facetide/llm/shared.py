"""Helpers for tables: maps over texts, size-checked broadcast, groups by links."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

TEXTS_PER_BATCH = 500
BROADCAST_ROWS = 2_000_000  # ids of 8 bytes: at most about 16 MB to each executor


def map_texts(rows: DataFrame, of: Callable, schema: str | T.StructType) -> DataFrame:
    """``rows.mapInArrow``, with batches small enough for rows that hold texts."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)

    def then_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of(batches)
        give_back()

    return rows.mapInArrow(then_small, schema)


def give_back() -> None:
    """Returns to the system what a task freed: Python workers live on, and the next stage's are beside them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def packed(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with each text as zstandard bytes, as it goes through a shuffle; null texts are empty."""
    names, at = rows.columns, rows.columns.index(text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = pa.array([packer.compress((t.as_buffer() or b"") if t.is_valid else b"") for t in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(len(names))], names)

    schema = T.StructType([T.StructField(text, T.BinaryType()) if f.name == text else f for f in rows.schema.fields])
    return map_texts(rows, of, schema)


def unpacked(texts: pa.Array) -> pa.Array:
    """Texts of ``packed`` rows."""
    opener = zstandard.ZstdDecompressor()
    return pa.array([opener.decompress(t.as_buffer()) for t in texts], pa.large_binary()).view(pa.large_string())


def only(docs: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``docs`` whose ``on`` is in ``ids`` (one row per id).

    The ids are counted first: up to ``BROADCAST_ROWS`` of them go to the scan as a broadcast, so
    the texts of other rows never leave their task; beyond it Spark joins by shuffle.
    """
    few = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, on, "left_semi")


def without(docs: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``docs`` whose ``on`` is not in ``ids`` (one row per id), by the same rule."""
    few = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, on, "left_anti")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (smallest node reachable) of every node of the undirected links.

    Large-star and small-star steps in turn: every node is tied to the smallest node it knows of, until
    nothing changes. Each round is two aggregations and joins over the links, written to the
    shared folder; no group of nodes is ever gathered in one task.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links"
    )
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u != v").distinct(), "links")
        after = _state(edges)
        if after == state:
            break
        state = after
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h
