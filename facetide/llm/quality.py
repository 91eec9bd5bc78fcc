"""Quality rules and an isolation forest on their statistics.

Rules count, over the whole text, words (``[^\\x20\\x09-\\x0D]+``), their characters, symbols, repeated lines and words in
repeated 3-word windows; two of them reject outright. For the rest an isolation forest is grown on shares of
these counts: all documents are dealt to ``TREES`` trees by a hash of their ids, each to one tree at least and, in small tables, to
so many that a tree has ``ROWS_PER_TREE``. A tree splits its documents at random values of random statistics until they are
alone or ``DEPTH`` deep, and a document's anomaly is 2 ** -(mean of path length / expected length in that tree). Trees grow level by
level: Spark finds the ranges of all nodes of a level in one aggregation over all documents. The threshold is
calibrated on all labelled rows: the anomaly that parts good from bad rows with fewest weighted errors, a good row
rejected weighing ``GOOD_WEIGHT`` bad ones kept.

Defined cases: null and empty texts have no words and fail the base rules; without labelled rows of both kinds nothing is
rejected beyond the base rules; several rows of one id are judged one by one, several labels count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from . import words as W
from .shared import BROADCAST_ROWS, map_texts

TREES = 100
ROWS_PER_TREE = 256
DEPTH = 8  # log2 of ROWS_PER_TREE
SPANS = 1 << 16  # of anomalies, for running sums
GOOD_WEIGHT = 2.0
SEED = 20

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_BLANKS = " \t\n\x0b\x0c\r"


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``STATISTICS`` of every document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.as_large(batch.column(1))
            for i, j in W.slices(texts):
                counts = _counted(texts.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in counts)], ["id", *STATISTICS])

    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = bare.schema["id"].dataType.simpleString()
    return map_texts(bare, of, f"id {kind}, " + ", ".join(f"{s} long" for s in STATISTICS))


def _counted(texts: pa.Array) -> list[np.ndarray]:
    data, offsets = W.buffer_of(texts)
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    words, at = W.word_hashes(texts, lower=False)
    grams, grams_at = W.shingles(words, at, 3)
    repeated = np.zeros(len(texts), dtype=np.int64)
    for r, (i, j) in enumerate(zip(grams_at[:-1].tolist(), grams_at[1:].tolist())):
        own = grams[i:j]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if same.any():
            twice = np.zeros(len(own) + 2, dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = twice.copy()
            covered[1:] |= twice[:-1]
            covered[2:] |= twice[:-2]
            repeated[r] = covered.sum()
    lines, again = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for r, text in enumerate(texts.to_pylist()):
        own = [x for x in text.split("\n") if x.strip(_BLANKS)]
        lines[r], again[r] = len(own), len(own) - len(set(own))
    chars = per_text(((data & 0xC0) != 0x80) & ~W._BLANK[data]) if len(data) else np.zeros(len(texts), np.int64)
    return [np.diff(at), chars, per_text(_SYMBOL[data]), again, repeated, lines, per_text(_UPPER[data]), per_text(_MARK[data])]


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Shares that do not grow with the text."""
    words, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
    return np.stack(
        [
            chars / words,
            counts["n_symbols"] / chars,
            counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1),
            counts["n_repeat_words"] / words,
            counts["n_upper"] / chars,
            counts["n_marks"] / chars,
        ],
        axis=1,
    )


class Forest(NamedTuple):
    """Per tree and node (the children of node i are 2i + 1 and 2i + 2): statistic (-1: leaf), value, path length; per tree its rows."""

    statistic: np.ndarray
    value: np.ndarray
    length: np.ndarray
    rows: np.ndarray


STRIDES = np.array([n for n in range(1, TREES) if gcd(n, TREES) == 1], dtype=np.uint64)


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def dealt(hashes: np.ndarray, each: int) -> np.ndarray:
    """``each`` different trees of every row."""
    bits = hashes.astype(np.int64).view(np.uint64)
    stride = STRIDES[(bits // np.uint64(TREES) % np.uint64(len(STRIDES))).astype(np.int64)]
    return ((bits % np.uint64(TREES))[:, None] + stride[:, None] * np.arange(each, dtype=np.uint64)).astype(np.int64) % TREES


def places(forest: Forest, trees: np.ndarray | int, x: np.ndarray) -> np.ndarray:
    """The node of its tree that each row ends in."""
    at = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    for _ in range(DEPTH):
        s = forest.statistic[trees, at]
        inner = s >= 0
        if not inner.any():
            break
        at = np.where(inner, 2 * at + 1 + (x[rows, np.maximum(s, 0)] > forest.value[trees, at]), at)
    return at


def grown(counts: DataFrame, id_col: str = "id") -> Forest:
    """The forest of all rows of ``counts`` (``STATISTICS``). What comes to the driver is one row per node."""
    shape = (TREES, 2 ** (DEPTH + 1) - 1)
    forest = Forest(np.full(shape, -1), np.zeros(shape), np.zeros(shape), np.zeros(TREES, dtype=np.int64))
    size = counts.count()
    if not size:
        return forest
    each = min(TREES, -(-TREES * ROWS_PER_TREE // size))
    bare = counts.select(F.xxhash64(id_col).alias("_hash"), *STATISTICS)
    width = features({s: np.ones(1) for s in STATISTICS}).shape[1]
    columns = ["tree", "node", *(f"x{i}" for i in range(width))]
    ranges = [edge(f"x{i}").alias(f"{name}{i}") for name, edge in (("low", F.min), ("high", F.max)) for i in range(width)]
    for depth in range(DEPTH + 1):
        sent = counts.sparkSession.sparkContext.broadcast(forest)

        def of(batches: Iterator[pa.RecordBatch], first: int = 2**depth - 1) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                trees = dealt(batch.column("_hash").to_numpy(), each).ravel()
                x = np.repeat(features({s: batch.column(s).to_numpy() for s in STATISTICS}), each, axis=0)
                nodes = places(sent.value, trees, x)
                open_ = nodes >= first
                yield pa.RecordBatch.from_arrays([pa.array(c[open_]) for c in (trees, nodes, *x.T)], columns)

        met = map_texts(bare, of, "tree long, node long, " + ", ".join(f"{c} double" for c in columns[2:]))
        found = met.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), *ranges).toArrow()
        low, high = (np.stack([found[f"{name}{i}"].to_numpy() for i in range(width)], axis=1) for name in ("low", "high"))
        split = False
        for row, (tree, node, n) in enumerate(zip(*(found[c].to_pylist() for c in ("tree", "node", "n")))):
            if not depth:
                forest.rows[tree] = n
            spread = np.flatnonzero(high[row] > low[row])
            if depth >= min(DEPTH, int(np.ceil(np.log2(max(forest.rows[tree], 2))))) or not len(spread):
                forest.length[tree, node] = depth + _expected(n)
                continue
            rng = np.random.default_rng([SEED, tree, node])
            s = int(rng.choice(spread))
            forest.statistic[tree, node], forest.value[tree, node] = s, rng.uniform(low[row, s], high[row, s])
            forest.length[tree, [2 * node + 1, 2 * node + 2]] = depth + 1
            split = True
        if not split:
            break
    return forest


def anomaly(forest: Forest, x: np.ndarray) -> np.ndarray:
    """From 0 to 1; ordinary rows near or below one half."""
    total = np.zeros(len(x))
    used = np.flatnonzero(forest.rows > 1).tolist()
    for tree in used:
        total += forest.length[tree, places(forest, tree, x)] / _expected(float(forest.rows[tree]))
    return 2.0 ** -(total / max(len(used), 1))


def threshold(known: DataFrame) -> float:
    """The ``anomaly`` above which rows are rejected, from all rows of ``known`` (``good`` 1 or 0); 1 if one kind is missing."""
    span = F.floor(F.col("anomaly") * SPANS).alias("_span")
    values = stored(known.groupBy("anomaly").agg(F.sum("good").alias("_good"), F.sum(1 - F.col("good")).alias("_bad")).select("*", span), "anomalies")
    n_good, n_bad = values.agg(F.sum("_good"), F.sum("_bad")).first()
    if not n_good or not n_bad:
        return 1.0
    earlier = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # over at most SPANS + 1 rows
    spans = values.groupBy("_span").agg(F.sum("_good").alias("_g"), F.sum("_bad").alias("_b"))
    before = spans.select("_span", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_g", "_b")))
    inside = Window.partitionBy("_span").orderBy("anomaly").rowsBetween(Window.unboundedPreceding, 0)
    rejected_good = F.lit(GOOD_WEIGHT) * (F.lit(n_good) - F.col("_g") - F.sum("_good").over(inside))  # rejecting what is above a value
    kept_bad = F.col("_b") + F.sum("_bad").over(inside)
    errors = values.join(F.broadcast(before), "_span").select("anomaly", (rejected_good + kept_bad).alias("_errors"))
    best = errors.agg(F.min(F.struct("_errors", "anomaly")).alias("_best")).first()._best.anomaly
    above = values.where(F.col("anomaly") > F.lit(best)).agg(F.min("anomaly")).first()[0]
    return (best + (best if above is None else above)) / 2


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id``, the counts, ``base_failed``, ``kept`` and ``anomaly`` of every document."""
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    counts = stored(rules(docs, id_col, text_col), "statistics").withColumn("base_failed", base)
    sent = docs.sparkSession.sparkContext.broadcast(grown(counts.where("NOT base_failed")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = anomaly(sent.value, features({s: batch.column(s).to_numpy() for s in STATISTICS}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "anomaly"])

    def scored(rows: DataFrame) -> DataFrame:
        return map_texts(rows, of, T.StructType([*rows.schema.fields, T.StructField("anomaly", T.DoubleType())]))

    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("good")).where("good IN (0, 1)")
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    cut = threshold(scored(counts.where("NOT base_failed").join(named, "id")).select("anomaly", "good"))
    kept = ~F.col("base_failed") & (F.col("anomaly") <= F.lit(cut))
    return scored(counts).select("id", *STATISTICS[:5], "base_failed", kept.alias("kept"), "anomaly")
