"""Label dictionaries and labelled folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import LABELS


def label_table(texts: DataFrame, content: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(idx, label) rows of label texts, one label per line, index from 0."""
    return texts.select(*keep, F.posexplode(text.label_lines(F.col(content))).alias("idx", "label"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The label table of one file; an empty file is an error."""
    found = label_table(spark.read.text(path, wholetext=True))
    if found.isEmpty():
        raise ValueError(f"label file is empty: {path}")
    return found


def label_values(spark: SparkSession, names: list[str]) -> DataFrame:
    """A label table from names already at hand, in class order."""
    return spark.createDataFrame(list(enumerate(names)), LABELS)


def read_labelled_folder(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Files of a tree whose folder names are labels: (path, length, label[, content]).

    Without ``content`` only file metadata is listed, no bytes are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    columns = ["path", "length"] + (["content"] if content else [])
    return files.select(*columns, F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"))


def rows_per_split(splits: dict[str, DataFrame]) -> DataFrame:
    """Row count of each named split, e.g. train and val."""
    tagged = [rows.select(F.lit(name).alias("split")) for name, rows in splits.items()]
    union = tagged[0]
    for more in tagged[1:]:
        union = union.unionAll(more)
    return union.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
