"""Token counts as delta-maintained rollups.

Totals of documents, characters and tokens by source, language and tokenizer version are kept as a folder of committed
batches, each a small table of signed sums. A batch is a change feed: rows with the image before (null for an
insert) and after (null for a delete); a revised count has both. Its delta adds the after images and subtracts the
before images, summed by group before anything is written. Sums are additive, so totals are the sum over batches.

A batch is committed under its id: the delta is written to ``_staged`` first and renamed to its place, which either
exists whole or not at all. A batch id that is there already is left alone, so a batch may be sent again after a
lost driver, and concurrent readers never see half of one.

Defined cases: null source, language or version are groups of their own; null texts count as documents without
tokens; groups whose documents have all been taken out are not listed; an empty batch commits no rows and is still known.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shared import map_texts
from .packing import encoder

GROUP = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_chars", "n_tokens")
WORDS = "words"

SCHEMA = ", ".join([*(f"{c} string" for c in GROUP), *(f"{c} long" for c in SUMS)])


def counted(docs: DataFrame, tokenizers: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``source``, ``lang``, ``tokenizer``, ``n_chars``, ``n_tokens``: one row per document and tokenizer version.

    ``tokenizers`` names files of word-level-split tokenizers; ``WORDS`` without a file counts words.
    """
    paths = dict(tokenizers)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.as_large(batch.column(3))
            for i, j in W.slices(texts):
                part = texts.slice(i, j - i)
                chars = pc.utf8_length(part).cast(pa.int64())
                for name, path in paths.items():
                    if path:
                        _, at = encoder(path).encode(part.cast(pa.large_binary()).to_pylist())
                    else:
                        _, at = W.word_hashes(part)
                    tokens = pa.array(np.diff(at), pa.int64())
                    own = [batch.column(k).slice(i, j - i) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([name] * (j - i)), chars, tokens], ["id", "source", "lang", "tokenizer", "n_chars", "n_tokens"])

    bare = docs.select(F.col(id_col).alias("id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text_col).alias("text"))
    kind = bare.schema["id"].dataType.simpleString()
    return map_texts(bare, of, f"id {kind}, source string, lang string, tokenizer string, n_chars long, n_tokens long")


def delta(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed sums of a batch from the ``counted`` rows it takes out and puts in."""
    parts = []
    for rows, sign in ((before, -1), (after, 1)):
        if rows is not None:
            parts.append(rows.select(*GROUP, F.lit(sign).cast("long").alias("n_docs"), *((sign * F.col(c)).alias(c) for c in SUMS[1:])))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS))


class Rollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Ids of the batches that count."""
        if not self._files.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.folder))]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def commit(self, batch: str, change: DataFrame) -> bool:
        """Add a batch's delta; False if the batch was there before."""
        place = self._path(f"{self.folder}/batch={batch}")
        if self._files.exists(place):
            return False
        staged = f"{self.folder}/_staged/{batch}-{uuid.uuid4().hex}"
        change.select(*GROUP, *SUMS).write.parquet(staged)
        if not self._files.exists(place) and self._files.rename(self._path(staged), place):
            return True
        return False

    def totals(self) -> DataFrame:
        """Current sums of every group that still has documents."""
        batches = self.committed()
        if not batches:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder}/batch={b}" for b in batches))
        return rows.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS)).where("n_docs != 0")
