"""Periodic runs of words, by tiles: octaves of periods, boundary Z-functions, stitched fragments.

A run is a stretch of words with smallest period q (words q apart are identical) and at least ``max(least, times * q)`` words
that no neighbouring word extends. Periods are treated by octaves [u, 2u) (those below 2 * ``UNIT`` together). A document is
exploded into tiles of 5u words, one around every u-th word (the boundary). A run of such a period repeats some whole block
of u words after a boundary within the octave, so only tiles whose block comes again (compared by fingerprints of u
words) go on; as rows of their own they are dealt to all tasks, however long their document is. Each tile is solved alone:
the Z-function of what follows the boundary gives the reach to the right of every period of the octave, that of the
reversed tile the reach to the left. A period whose root repeats a shorter one is dropped. The fragments are shuffled by
(document, period) and stitched where they overlap by a period or more; neighbouring tiles of one run always do, and
two runs of one period never.

Words are compared by 64-bit hashes. A row is known by its key, a hash of its id and text, so rows repeated whole give the
same result each.

Defined cases: null, empty and blank texts have no words and no runs; null ids are kept; repeated rows are answered each;
texts may be of any length; other columns are not read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import words as W
from .shared import map_texts

LEAST_WORDS = 24
TIMES = 3  # least number of periods in a run
UNIT = 8  # words between the boundaries of the lowest tiles; needs LEAST_WORDS - 7 >= 2 * UNIT - 1
TILE_WORDS = 1 << 20  # words of tiles made at once
RUNS_SENT = 250_000  # runs of 24 bytes that may go to the scans; more are joined by shuffle

TILES = "key string, unit long, place long, codes binary"
FRAGMENTS = "key string, period long, start long, end long"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key``, ``id`` and ``text`` of every row."""
    both = F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("none")), text_col)
    return docs.select(F.md5(both.cast("binary")).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _unlike(n: int, seed: int) -> np.ndarray:
    """``n`` values that equal no word and not each other."""
    return W.mix(np.arange(n, dtype=np.uint64) + np.uint64(seed << 40))


class _Texts:
    """Words of several texts in one array, a value of its own after each text."""

    def __init__(self, texts: pa.Array):
        hashes, at = W.word_hashes(texts, lower=False)
        n = len(texts)
        self.words = np.insert(hashes, at[1:], _unlike(n, 1))
        self.counts = np.diff(at)
        self.starts = at[:-1] + np.arange(n)
        self.names = np.arange(n)
        self.blocks = self.words  # fingerprint of the ``span`` words from each place on
        self.span = 1

    def double(self) -> None:
        ahead = np.concatenate([self.blocks[self.span :], _unlike(min(self.span, len(self.blocks)), 2)])
        self.blocks = W.mix(self.blocks * np.uint64(W.BASE) + ahead)
        self.span *= 2

    def keep(self, least: int) -> None:
        """Forget texts of fewer than ``least`` words once they are a good part."""
        stay = self.counts >= least
        if (self.counts[stay] + 1).sum() > 0.7 * len(self.words):
            return
        mask = np.repeat(stay, self.counts + 1)
        self.words, self.blocks = self.words[mask], self.blocks[mask]
        self.counts, self.names = self.counts[stay], self.names[stay]
        self.starts = np.concatenate([[0], np.cumsum(self.counts + 1)])[:-1].astype(np.int64)

    def boundaries(self, unit: int) -> np.ndarray:
        """Every unit-th place whose block comes again after a period of the octave."""
        short = -len(self.blocks) % unit
        rows = np.concatenate([self.blocks, _unlike(short, 3)]).reshape(-1, unit)
        again = np.zeros(len(rows), dtype=bool)
        again[:-1] = (rows[1:] == rows[:-1, :1]).any(axis=1)
        if unit == UNIT:  # the lowest tiles also hold the periods below
            again |= (rows[:, 1:] == rows[:, :1]).any(axis=1)
        return np.flatnonzero(again) * unit

    def codes(self, boundaries: np.ndarray, unit: int) -> np.ndarray:
        """The words around each boundary as small numbers; what lies outside the array equals nothing."""
        at = boundaries[:, None] + np.arange(-unit, 4 * unit)
        outside = (at < 0) | (at >= len(self.words))
        _, numbers = np.unique(self.words[np.clip(at, 0, len(self.words) - 1)], return_inverse=True)
        numbers = numbers.reshape(at.shape).astype(np.int32)
        numbers[outside] = -1 - np.arange(outside.sum(), dtype=np.int32)
        return numbers


def _tiles(rows: DataFrame) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.as_large(batch.column(1))
            for i, j in W.slices(texts):
                held = _Texts(texts.slice(i, j - i))
                unit = UNIT
                while len(held.counts) and held.counts.max() >= max(LEAST_WORDS, TIMES * unit):
                    held.keep(max(LEAST_WORDS, TIMES * unit) if unit > UNIT else LEAST_WORDS)
                    while held.span < unit:
                        held.double()
                    found = held.boundaries(unit)
                    step = max(1, TILE_WORDS // (5 * unit))
                    for k in range(0, len(found), step):
                        c = found[k : k + step]
                        of_text = np.searchsorted(held.starts, c, side="right") - 1
                        numbers = held.codes(c, unit)
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(pa.array(i + held.names[of_text])),
                                pa.array(np.full(len(c), unit, dtype=np.int64)),
                                pa.array(c - held.starts[of_text]),
                                pa.array([row.tobytes() for row in numbers], pa.binary()),
                            ],
                            ["key", "unit", "place", "codes"],
                        )
                    unit *= 2

    return map_texts(rows.where("text IS NOT NULL").select("key", "text"), of, TILES)


def z_function(values: list, most: int) -> list[int]:
    """For each of the first ``most`` places, how many values from there on equal those from the start."""
    n = len(values)
    z = [0] * min(n, most)
    left = right = 0
    for i in range(1, len(z)):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and values[k] == values[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
    return z


def _prime_factors(n: int) -> tuple[int, ...]:
    found, d = [], 2
    while d * d <= n:
        if n % d == 0:
            found.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return (*found, n) if n > 1 else tuple(found)


def solved(tile: list[int], unit: int) -> list[tuple[int, int, int]]:
    """(period, reach to the left, reach to the right) of the stretches around the boundary, whose root repeats nothing.

    The stretch of period p goes from ``reach to the left`` words before the boundary to p + ``reach to the right`` after it.
    """
    ahead = z_function(tile[unit:], 2 * unit)
    periods = [
        p
        for p in range(1 if unit == UNIT else unit, 2 * unit)
        if ahead[p] >= unit and not any(ahead[p // r] >= p - p // r for r in _prime_factors(p))
    ]
    if not periods:
        return []
    back = z_function([*tile[unit - 1 :: -1], None, *tile[3 * unit - 1 :: -1]], 4 * unit + 1)
    return [(p, back[3 * unit + 1 - p], ahead[p]) for p in periods]


def _fragments(tiles: DataFrame) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            units, places, codes = (batch.column(i) for i in (1, 2, 3))
            for row in range(batch.num_rows):
                unit, place = units[row].as_py(), places[row].as_py()
                tile = np.frombuffer(codes[row].as_buffer(), dtype=np.int32).tolist()
                for period, left, right in solved(tile, unit):
                    rows.append(row)
                    found.append((period, place - left, place + period + right))
            columns = np.array(found, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(columns[:, k]) for k in range(3))], ["key", "period", "start", "end"])

    return tiles.mapInArrow(of, FRAGMENTS)


def runs(rows: DataFrame, least: int = LEAST_WORDS, times: int = TIMES) -> DataFrame:
    """``key``, ``start`` (word number), ``length``, ``period`` of every run of the rows made by ``keyed``."""
    if least < LEAST_WORDS or times < TIMES:
        raise ValueError(f"the tiles find runs of at least {LEAST_WORDS} words and {TIMES} periods")
    tiles = _tiles(rows).repartition("key", "unit", "place")
    pieces = _fragments(tiles)
    of_period = Window.partitionBy("key", "period").orderBy("start", "end")
    reached = F.max("end").over(of_period.rowsBetween(Window.unboundedPreceding, -1))
    apart = (reached.isNull() | (F.col("start") > reached - F.col("period"))).cast("int")
    numbered = pieces.withColumn("apart", apart).withColumn("stretch", F.sum("apart").over(of_period))
    whole = numbered.groupBy("key", "period", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    long = whole.select("key", "start", (F.col("end") - F.col("start")).alias("length"), "period")
    return long.where(F.col("length") >= F.greatest(F.lit(least), F.col("period") * times))


def collapsed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``id``, ``runs`` (sorted by start, then period) and ``collapsed`` of every row: its words, joined by one blank, without
    those that a run holds after its first period."""
    few = found.count() <= RUNS_SENT
    lists = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("found"))  # one text's
    joined = rows.join(F.broadcast(lists) if few else lists, "key", "left").select("id", "text", "found")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_joined(t, r) for t, r in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string())], ["id", "found", "collapsed"])

    def _joined(text: pa.Scalar, spans: pa.Scalar) -> str:
        words = (text.as_py() or "").encode().split()
        if spans.is_valid:
            keep = np.ones(len(words), dtype=bool)
            for s in spans.as_py():
                keep[s["start"] + s["period"] : s["start"] + s["length"]] = False
            words = [words[k] for k in np.flatnonzero(keep).tolist()]
        return b" ".join(words).decode()

    kind = joined.schema
    schema = f"id {kind['id'].dataType.simpleString()}, found {kind['found'].dataType.simpleString()}, collapsed string"
    out = map_texts(joined, of, schema)
    in_order = F.transform(F.coalesce("found", F.array().cast(kind["found"].dataType)), lambda r: F.struct(r.start.alias("start"), r.length.alias("length"), r.period.alias("period")))
    return out.select("id", in_order.alias("runs"), "collapsed")


def digests(shown: DataFrame) -> DataFrame:
    """The runs of each row in figures, and hashes of the runs and of the collapsed text.

    The run of greatest exponent is found by its quotient in doubles, which tells any two apart while length times period stays
    under 2**53.
    """
    greatest = F.array_max(F.transform("runs", lambda r: F.struct((r.length / r.period).alias("exponent"), (-r.start).alias("start"), (-r.period).alias("period"), r.length.alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    best = shown.withColumn("best", greatest)
    return best.select(
        "id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``runs`` and ``collapsed`` text of every row of ``docs``."""
    rows = keyed(docs, id_col, text_col)
    return collapsed(rows, stored(runs(rows), "runs"))


def repeated_tail(doc_id: str, text: str) -> F.Column:
    """The text of a document, whose words are repeated from some place on if its id's checksum ends with 0.

    With h the crc32 of the decimal id and g = h div 10: if h % 10 = 0, each of the n words from a = g % n on becomes word
    a + (i - a) % p, with p = 1 + (n - a) div (3 + g % 8).
    """
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size(words).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    spot = F.struct(words.alias("words"), a.alias("a"), p.alias("p"))
    place = lambda s, i: F.when(i < s.a, i).otherwise(s.a + (i - s.a) % s.p)
    repeated = F.element_at(F.transform(F.array(spot), lambda s: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.size(s.words).cast("long") - 1), lambda i: F.get(s.words, place(s, i).cast("int"))), " ")), 1)
    return F.when((h % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]"), repeated).otherwise(F.col(text))
