"""Vector code compression: product codes by k-means on whole numbers, found through memoised grid cells.

A vector's components become integers floor(scale * x). It is cut into ``parts`` equal consecutive parts; each part position has
its own codebook of ``entries`` points. A part is coded by its nearest entry (squared Euclidean distance, ties to the
lower index). To find it, the part's coarse cell (components divided by the cell's side) is looked up in a table: for each
cell it keeps the entries that are nowhere dominated in the cell's box, those whose least distance to the box is no
larger than the smallest of all greatest distances. A new cell's entries are found once, from both distances summed over the
dimensions, and remembered; only they are then compared exactly. The remembered table of a task holds ``CELLS`` cells; beyond
it cells are worked out again, with the same outcome.

Each round is one pass over the vectors: a task adds up components and counts of each entry, Spark adds up the tasks, and
the driver holds no more than the codebooks. Sums are decimals, so every result is exact and the same in any order.

Defined cases: vectors that are null or hold null, NaN or infinite components are dropped; with fewer vectors than entries the
codebook is smaller; null ids come last among those that start it, equal ids in the order of their components; entries
that no part chose stay; repeated rows are coded each, and counted each; an empty table gives an empty one; columns but
id, vector and label are not read. Vectors of different lengths, or of one that ``parts`` does not divide, and components of
2**25 or more after scaling (their errors would not fit a long) are errors that name the cause.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .shared import BROADCAST_ROWS

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LARGEST = 1 << 25
CELLS = 200_000  # cells a task remembers, of one bit per entry each
WORKED = 512  # parts compared at once

Codebooks = list[np.ndarray]  # per part: entries x components, int64


def whole_vectors(vectors: DataFrame, vector_col: str, scale: int = SCALE) -> DataFrame:
    """The rows whose vector is whole, with integer components (array of long) in its place."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.where(x.isNotNull() & F.coalesce(finite, F.lit(False)))
    too_large = F.exists(x, lambda v: F.abs(v.cast("double") * scale) >= LARGEST)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    message = F.lit(f"a component is {LARGEST} or more after scaling")
    return kept.withColumn(vector_col, F.when(too_large, F.raise_error(message).cast("array<bigint>")).otherwise(whole))


def _matrix(column: pa.Array, parts: int, dimensions: int) -> np.ndarray:
    """Rows x parts x components."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(column) and (len(values) != len(column) * dimensions or (column.value_lengths().to_numpy() != dimensions).any()):
        raise ValueError(f"all vectors must have {dimensions} components, a multiple of {parts}")
    return values.reshape(len(column), parts, dimensions // parts if parts else 0)


def cell_side(entries: np.ndarray) -> int:
    """A power of two: about half the distance, per dimension, of an entry to its nearest other one (the median of all)."""
    if len(entries) < 2 or not entries.shape[1]:
        return 1
    nearest = []
    for i in range(len(entries)):
        gaps = ((entries - entries[i]).astype(np.float64) ** 2).sum(axis=1)
        gaps[i] = np.inf
        nearest.append(gaps.min())
    per_dimension = float(np.sqrt(np.median(nearest) / entries.shape[1])) / 2
    return 1 << max(0, int(per_dimension).bit_length() - 1)


class Cells:
    """Nearest entries of one codebook, through the cells seen so far."""

    def __init__(self, entries: np.ndarray, most: int = CELLS):
        self.entries, self.side, self.most = entries, cell_side(entries), most
        self.kept: dict[bytes, np.ndarray] = {}

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """cells x entries: may the entry be nearest to some point of the cell's box?"""
        least = np.zeros((len(cells), len(self.entries)))
        most = np.zeros_like(least)
        for d in range(cells.shape[1]):
            values, place = np.unique(cells[:, d], return_inverse=True)
            low = (values * self.side)[:, None]
            high = low + self.side - 1
            entry = self.entries[None, :, d]
            least += (np.maximum(np.maximum(low - entry, entry - high), 0).astype(np.float64) ** 2)[place]
            most += (np.maximum(np.abs(entry - low), np.abs(high - entry)).astype(np.float64) ** 2)[place]
        # Rounding of sums beyond 2**53 may only keep too many.
        return least * (1 - 1e-12) <= most.min(axis=1, keepdims=True) * (1 + 1e-12)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """points x entries, from the remembered cells or worked out."""
        cells, place = np.unique(points // self.side, axis=0, return_inverse=True)
        names = [row.tobytes() for row in np.ascontiguousarray(cells)]
        new = [i for i, name in enumerate(names) if name not in self.kept]
        fresh = dict(zip(new, np.packbits(self.undominated(cells[new]), axis=1))) if new else {}
        bits = np.array([fresh[i] if i in fresh else self.kept[names[i]] for i in range(len(names))])
        for i in new[: max(0, self.most - len(self.kept))]:
            self.kept[names[i]] = fresh[i]
        return np.unpackbits(bits, axis=1, count=len(self.entries)).astype(bool)[place.reshape(-1)]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each point."""
        index, errors = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        if not points.shape[1]:
            return index, errors
        for i in range(0, len(points), WORKED):
            some = points[i : i + WORKED]
            row, entry = np.nonzero(self.candidates(some))
            error = ((some[row] - self.entries[entry]) ** 2).sum(axis=1)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            best = np.minimum.reduceat(error, first)
            hit = np.flatnonzero(error == best[row])  # rows are in order, and the entries of each row too
            hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
            index[i : i + WORKED], errors[i : i + WORKED] = entry[hit], best
        return index, errors


def first_codebooks(whole: DataFrame, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES) -> tuple[Codebooks, int]:
    """The parts of the ``entries`` vectors of smallest id, and the vectors' length; at most ``entries`` rows are collected."""
    first = whole.orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(entries).select(vector_col).collect()
    dimensions = len(first[0][0]) if first else 0
    if any(len(r[0]) != dimensions for r in first) or dimensions % parts:
        raise ValueError(f"all vectors must have one length, a multiple of {parts}")
    points = np.array([r[0] for r in first], dtype=np.int64).reshape(len(first), parts, dimensions // parts)
    return [points[:, k] for k in range(parts)], dimensions


def improved(whole: DataFrame, vector_col: str, books: Codebooks, dimensions: int) -> Codebooks:
    """One round: every part goes to its nearest entry, every entry to the floor of the mean of its parts."""
    parts, width = len(books), dimensions // len(books)
    if not width:
        return books

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book) for book in books]
        sums = [np.zeros(book.shape, dtype=np.int64) for book in books]  # of one task: under 2**63 / 2**25 rows
        counts = [np.zeros(len(book), dtype=np.int64) for book in books]
        for batch in batches:
            points = _matrix(batch.column(0), parts, dimensions)
            for k in range(parts):
                index, _ = cells[k].nearest(points[:, k])
                np.add.at(sums[k], index, points[:, k])
                counts[k] += np.bincount(index, minlength=len(counts[k]))
        for k in range(parts):
            used = np.flatnonzero(counts[k])
            rows = [np.full(len(used) * width, k), np.repeat(used, width), np.tile(np.arange(width), len(used)), sums[k][used].ravel(), np.repeat(counts[k][used], width)]
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)) for r in rows], ["part", "entry", "place", "total", "n"])

    made = whole.select(vector_col).mapInArrow(of, "part long, entry long, place long, total long, n long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = [book.copy() for book in books]
    for r in made.groupBy("part", "entry", "place").agg(exact("total"), exact("n")).collect():  # the codebooks' size
        out[r.part][r.entry, r.place] = int(r.total) // int(r.n)
    return out


def trained(whole: DataFrame, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, int]:
    books, dimensions = first_codebooks(whole, id_col, vector_col, parts, entries)
    for _ in range(rounds if len(books[0]) else 0):
        books = improved(whole, vector_col, books, dimensions)
    return books, dimensions


def coded(whole: DataFrame, id_col: str, vector_col: str, carried: list[str], books: Codebooks, dimensions: int) -> DataFrame:
    """Every row's id, ``carried`` columns, ``code`` (array of entry numbers) and ``error``."""
    parts = len(books)
    columns = [id_col, *carried]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book) for book in books]
        for batch in batches:
            points = _matrix(batch.column(len(columns)), parts, dimensions)
            found = [cells[k].nearest(points[:, k]) for k in range(parts)]
            code = np.stack([index for index, _ in found], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype=np.int32) * parts), pa.array(code.ravel()))
            errors = pa.array(sum(error for _, error in found).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), lists, errors], [f"_{i}" for i in range(len(columns))] + ["code", "error"])

    rows = whole.select(*columns, vector_col)
    kinds = ", ".join(f"_{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(columns)))
    made = rows.mapInArrow(of, f"{kinds}, code array<int>, error bigint")
    return made.select(*[F.col(f"_{i}").alias(name) for i, name in enumerate(columns)], "code", "error")


def hex_code(code: Column) -> Column:
    """Two lower-case hex digits per entry number."""
    return F.array_join(F.transform(code, lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")), "")


def codebooks_digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id``, ``code``, ``error``, ``label_error`` (errors summed over equal labels) and ``codebooks_sha256``."""
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    whole = whole_vectors(named, "vector")
    books, dimensions = trained(whole, "id", "vector")
    rows = stored(coded(whole, "id", "vector", ["label"], books, dimensions), "codes")
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    # A label may hold a third of all rows: a few totals go to the rows; many are joined, and Spark splits a large label's rows.
    few = totals.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("id", hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
