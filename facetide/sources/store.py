"""Stored events as tables: Parquet folders with drifting schemas, unions of store versions."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EVENT_STORED

DEEPEST = 2  # sub-folders below the store
NOTHING_TO_READ = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}
WIDENED = (T.NumericType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def read_events(spark: SparkSession, path: str | None, schema: T.StructType = EVENT_STORED) -> DataFrame:
    """The Parquet files of a folder and of its sub-folders, two levels deep, merged by column name.

    Sub-folders may be Hive partitions, whose values become columns, or plain ones; both may stand beside files at the
    root. A column some files lack is null there. Files whose types Spark can't merge are read in groups of one schema
    each and united as ``union_events`` does. A missing or empty folder gives an empty table with ``schema``.
    """
    root = (path or "").rstrip("/")
    folders = _folders(spark, root) if root else []
    by_partition: dict[tuple, list[str]] = {}
    for folder in folders:
        by_partition.setdefault(_partition_columns(folder), []).append(f"{root}{folder}/*.parquet")
    parts = [part for globs in by_partition.values() for part in _merged(spark, sorted(globs), root)]
    return union_events(*parts) if parts else spark.createDataFrame([], schema)


def _folders(spark: SparkSession, root: str) -> list[str]:
    """Sub-folders that hold Parquet files, from ``root`` on ("" is the root itself). Spark lists the files; only their folders come here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    try:
        found = files.load(root)
    except AnalysisException as error:
        if error.getCondition() not in NOTHING_TO_READ:
            raise
        return []
    place = re.sub("^file:/+", "/", root).split("://")[-1]
    below = F.element_at(F.split("path", re.escape(place), 2), 2)
    folders = found.select(F.regexp_replace(below, "/[^/]*$", "").alias("folder")).distinct()
    return sorted(r.folder for r in folders.where(F.size(F.split("folder", "/")) <= DEEPEST + 1).collect())


def _partition_columns(folder: str) -> tuple:
    """Names of the Hive partitions a folder ends with."""
    names: list[str] = []
    for part in reversed(folder.split("/")):
        if "=" not in part:
            break
        names.insert(0, part.split("=", 1)[0])
    return tuple(names)


def _merged(spark: SparkSession, globs: list[str], root: str) -> list[DataFrame]:
    """The files in as few tables as their types allow."""
    groups: dict[str, list[str]] = {}
    for some in _mergeable(spark, globs, root):
        groups.setdefault(_read(spark, some, root).schema.json(), []).extend(some)
    return [_read(spark, some, root) for some in groups.values()]


def _mergeable(spark: SparkSession, globs: list[str], root: str) -> list[list[str]]:
    """The list halved until Spark can merge the types of each part; a folder's own files come last."""
    try:
        _read(spark, globs, root)
        return [globs]
    except Exception as error:  # pyspark has no class of its own for it
        if "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
    if len(globs) == 1:
        globs = sorted(r.path for r in spark.read.format("binaryFile").load(globs[0]).select("path").collect())
    middle = len(globs) // 2
    return _mergeable(spark, globs[:middle], root) + _mergeable(spark, globs[middle:], root)


def _read(spark: SparkSession, globs: list[str], root: str) -> DataFrame:
    return spark.read.option("basePath", root).option("mergeSchema", True).parquet(*globs)


def union_events(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows, columns matched by name; a column one side lacks is null there.

    Numbers of different width, and dates with times, are widened as Spark's union does; other columns that
    the sides have under different types become text.
    """
    kinds: dict[str, list[T.DataType]] = {}
    for side in (first, *others):
        for field in side.schema.fields:
            kinds.setdefault(field.name, []).append(field.dataType)

    def unlike(name: str) -> bool:
        return any(kind != kinds[name][0] for kind in kinds[name]) and not any(all(isinstance(kind, family) for kind in kinds[name]) for family in WIDENED)

    as_text = {name: F.col(name).cast("string") for name in kinds if unlike(name)}
    out = None
    for side in (first, *others):
        side = side.withColumns({name: text for name, text in as_text.items() if name in side.columns})
        out = side if out is None else out.unionByName(side, allowMissingColumns=True)
    return out


def stream_events(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """New Parquet files of a folder as a stream, optionally at most ``max_files`` per trigger."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
