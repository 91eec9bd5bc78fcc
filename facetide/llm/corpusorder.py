"""Suffix-array dedup by prefix-free parsing: bytes that a ``least``-byte string of an earlier document covers.

A corpus order puts all suffixes in order; suffixes that begin with the same ``least`` bytes are neighbours, one class. A
document loses the bytes of each class whose smallest id is not its own. The order is never made for all bytes:

1. Rolling-hash triggers cut each text into phrases, twice: into long ones (the hash of ``TRIGGER`` bytes is 0 modulo
   ``SPACING``), and into short ones (the least hash of the ``GRAM``-byte strings in the ``least`` bytes from a place on changes;
   so every string of ``least`` bytes has one trigger, the same wherever it stands). A phrase is taken with the bytes that follow it in
   the parse as far as suffixes that begin in it reach, ``least - 1``; equal ones then hold equal suffixes.
2. Long phrases are the dictionary's first level: of equal ones the smallest id is the owner; in other documents
   all suffixes that begin in it are settled. Copies end here, however many they are. At the same time the short
   phrases' triggers are counted: a suffix can only be shared if its trigger stands in two texts.
3. What is left, short phrases outside settled ones with a trigger in two texts, is the dictionary proper. Equal entries have one
   owner. The suffixes of the distinct ones (a dictionary suffix and the parse after it, up to ``least`` bytes) are put in
   order, those of a trigger together: a suffix array by prefix doubling gives the classes, and the parse, the
   places where an entry stands, the bytes they cover. A trigger of more than ``HOT`` entries is not held by one task: there
   equal entries and suffixes are aggregated and joined by Spark over all tasks.

In step 2 the asking is packed: a block of texts (``BLOCK_BYTES``) settles what it can alone, so one block asks at most once per
phrase or trigger, and its questions go by hash buckets of about ``BUCKET_BYTES`` of text; the answers meet the texts by groups of
that size. No group grows with the copies of a phrase.
A trigger's 32 bits within its bucket are a filter, so a false match costs work but no exactness; long phrases are equal by 128
bits of hash, short ones and suffixes by their bytes.

Defined cases: null and empty texts have no bytes; a null id neither loses bytes nor takes them from others; rows of one id
never take bytes from each other; texts shorter than ``least`` stay whole; texts may be of any length; other columns are
not read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_folder
from . import words as W
from .shared import map_texts, only, packed, unpacked, without

LEAST_BYTES = 50
TRIGGER = 16
SPACING = 128
GRAM = 25
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 8 << 20
ENTRIES = 20_000  # dictionary entries of a task whose suffix array is made at once, whole triggers
HOT = 5_000  # entries of a trigger beyond which its suffixes are sorted by all tasks
SUFFIXES = 1 << 18  # suffixes sent at once
BASE_2 = 0xD1342543DE82EF95  # of the second hash

TRIGGERS, PHRASES, TRIGGERS_FOUND, SETTLED = range(4)  # kinds of packed rows
ASKED = "bucket long, kind int, keys binary, more binary, lines binary, ids binary, starts binary, ends binary"
ENTRY_COLUMNS = ["trigger", "body", "line", "id", "start", "end"]
COLUMNS = ASKED.split(" ")[::2]
U = np.uint64


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    """As ``session.stored``, compressed more."""
    path = fresh_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Bytes:
    """Bytes of several texts in one array, a divider after each, with their running hashes."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = W.buffer_of(texts)
        self.starts, self.ends = offsets[:-1], offsets[1:] - 1
        self._sums: dict[int, np.ndarray] = {}

    def sums(self, base: int) -> np.ndarray:
        if base not in self._sums:
            sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum((self.data + U(1)) * W._powers(base, len(self.data)), out=sums[1:])
            self._sums[base] = sums
        return self._sums[base]

    def hashes(self, first: np.ndarray, end: np.ndarray, base: int = W.BASE) -> np.ndarray:
        sums = self.sums(base)
        return W.mix((sums[end] - sums[first]) * W._powers(pow(base, -1, 1 << 64), len(self.data) + 1)[first] + (end - first).astype(np.uint64))

    def grams(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each place on."""
        sums, n = self.sums(W.BASE), len(self.data) - width + 1
        return W.mix((sums[width:] - sums[:-width]) * W._powers(pow(W.BASE, -1, 1 << 64), len(self.data) + 1)[:n]) if n > 0 else np.zeros(0, np.uint64)

    def long_phrases(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first byte and end of every long phrase, with the ``least - 1`` bytes that follow it; those of fewer than ``least`` bytes left out."""
        cuts = np.flatnonzero(self.grams(TRIGGER) % U(SPACING) == 0)
        first = np.unique(np.concatenate([cuts, self.starts]))
        text = np.searchsorted(self.starts, first, side="right") - 1
        # Empty texts share no start with others, as each text ends with a divider.
        end = np.minimum(np.append(first[1:], len(self.data)) + least - 1, self.ends[text])
        fits = end - first >= least
        return text[fits], first[fits], end[fits]

    def short_phrases(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first byte, end (as above) and trigger of every short phrase."""
        values, width = self.grams(GRAM), least - GRAM + 1
        n = len(values) - width + 1
        if n <= 0:
            return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
        high = np.full(-len(values) % width, np.iinfo(np.uint64).max, dtype=np.uint64)
        rows = np.concatenate([values, high]).reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        trigger = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
        inside = np.zeros(n + 1, dtype=np.int8)  # places from which a text has ``least`` bytes
        long = self.ends - self.starts >= least
        inside[self.starts[long]] = 1
        inside[self.ends[long] - least + 1] -= 1
        inside = np.cumsum(inside[:n]).astype(bool)
        change = np.ones(n, dtype=bool)
        change[1:] = (trigger[1:] != trigger[:-1]) | ~inside[:-1]
        first = np.flatnonzero(change & inside)
        stop = np.ones(n, dtype=bool)
        stop[:-1] = change[1:] | ~inside[1:]
        last = np.flatnonzero(stop & inside)
        return np.searchsorted(self.starts, first, side="right") - 1, first, last + least, W.mix(trigger[first])


def trigger_key(trigger: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a trigger as one number."""
    return ((trigger >> U(32)) % U(buckets)).astype(np.int64) << 32 | (trigger & U(0xFFFFFFFF)).astype(np.int64)


def _packed(buckets: np.ndarray, kind: int, keys=None, more=None, lines=None, ids=None, starts=None, ends=None) -> pa.RecordBatch:
    """One row per bucket, the arrays of its members as bytes."""
    order = np.argsort(buckets, kind="stable")
    sorted_buckets = buckets[order]
    first = np.flatnonzero(np.diff(sorted_buckets, prepend=-1))
    bounds = [*first.tolist(), len(order)]

    def column(values: np.ndarray | None) -> pa.Array:
        if values is None:
            return pa.nulls(len(first), pa.binary())
        values = values[order]
        return pa.array([values[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary())

    return pa.RecordBatch.from_arrays(
        [pa.array(sorted_buckets[first]), pa.array(np.full(len(first), kind, dtype=np.int32)), *(column(v) for v in (keys, more, lines, ids, starts, ends))], COLUMNS
    )


def _asked(rows: DataFrame, least: int, buckets: int) -> DataFrame:
    """Questions of each block of texts, and what the block settles alone."""

    def triggers(lines: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((lines, keys))
        lines, keys = lines[order], keys[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (lines[1:] != lines[:-1])
        lines, keys = lines[new], keys[new]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        several = np.repeat(np.diff(np.append(first, len(keys))) > 1, np.diff(np.append(first, len(keys))))
        yield _packed(lines[several] % buckets, TRIGGERS_FOUND, keys=keys[several], lines=lines[several])
        head = np.zeros(len(keys), dtype=bool)
        head[first] = True
        asking = head | ~several  # of several texts one question goes on
        bucket = keys[asking] >> 32
        yield _packed(bucket, TRIGGERS, keys=(keys[asking] & 0xFFFFFFFF).astype(np.uint32), lines=lines[asking], more=several[asking].astype(np.uint8))

    def phrases(lines, ids, starts, ends, one, two) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((ids, two, one))
        lines, ids, starts, ends, one, two = (v[order] for v in (lines, ids, starts, ends, one, two))
        new = np.ones(len(one), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        owner = ids[np.maximum.accumulate(np.where(new, np.arange(len(one)), 0))] if len(one) else ids
        later = ids > owner
        yield _packed(lines[later] % buckets, SETTLED, lines=lines[later], starts=starts[later], ends=ends[later])
        bucket = (one[~later] % U(buckets)).astype(np.int64)
        yield _packed(bucket, PHRASES, one[~later], two[~later], lines[~later], ids[~later], starts[~later], ends[~later])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple]] = [[], []]
        held = 0
        for batch in batches:
            names, numbers, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), W.as_large(batch.column(2))
            for i, j in W.slices(texts):
                data = _Bytes(texts.slice(i, j - i))
                text, first, end = data.long_phrases(least)
                found[1].append((names[i + text], numbers[i + text], first - data.starts[text], end - data.starts[text], data.hashes(first, end), data.hashes(first, end, BASE_2)))
                text, _, _, trigger = data.short_phrases(least)
                found[0].append((names[i + text], trigger_key(trigger, buckets)))
                held += len(data.data)
                if held >= BLOCK_BYTES:
                    yield from triggers(*map(np.concatenate, zip(*found[0])))
                    yield from phrases(*map(np.concatenate, zip(*found[1])))
                    found, held = [[], []], 0
        if held:
            yield from triggers(*map(np.concatenate, zip(*found[0])))
            yield from phrases(*map(np.concatenate, zip(*found[1])))

    return map_texts(rows, of, ASKED)


def _joined(table: pa.Table, kind: int, name: str, dtype=np.int64) -> np.ndarray:
    """The packed numbers of one kind and column."""
    rows = [v.as_buffer() for k, v in zip(table.column("kind").to_pylist(), table.column(name)) if k == kind]
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(v, dtype) for v in rows)])


def _answered(asked: DataFrame, buckets: int) -> DataFrame:
    """By groups of texts, packed: triggers that stand in another text too, and places in long phrases that an earlier text owns."""

    def of(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        keys, lines = _joined(table, TRIGGERS, "keys", np.uint32), _joined(table, TRIGGERS, "lines")
        several = _joined(table, TRIGGERS, "more", np.uint8)
        _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
        twice = (count > 1) | (np.bincount(number, weights=several, minlength=len(count)) > 0)
        hit = twice[number] & (several == 0)  # the others' blocks know
        trigger_lines = np.concatenate([lines[hit], _joined(table, TRIGGERS_FOUND, "lines")])
        trigger_keys = np.concatenate([bucket << 32 | keys[hit].astype(np.int64), _joined(table, TRIGGERS_FOUND, "keys")])
        one, two = _joined(table, PHRASES, "keys", np.uint64), _joined(table, PHRASES, "more", np.uint64)
        ids, lines = _joined(table, PHRASES, "ids"), _joined(table, PHRASES, "lines")
        starts, ends = _joined(table, PHRASES, "starts"), _joined(table, PHRASES, "ends")
        order = np.lexsort((ids, two, one))
        new = np.ones(len(one), dtype=bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        owner = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(one)), 0))] if len(one) else ids
        later = order[ids[order] > owner]
        lines, starts, ends = (np.concatenate([v[later], _joined(table, SETTLED, name)]) for v, name in ((lines, "lines"), (starts, "starts"), (ends, "ends")))
        return pa.Table.from_batches(
            [
                _packed(trigger_lines % buckets, TRIGGERS_FOUND, keys=trigger_keys, lines=trigger_lines),
                _packed(lines % buckets, SETTLED, lines=lines, starts=starts, ends=ends),
            ]
        )

    return asked.groupBy("bucket").applyInArrow(of, ASKED)


def _merged(lines: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each text, those that touch put together."""
    if not len(lines):
        return lines, starts, ends
    order = np.lexsort((starts, lines))
    lines, starts, ends = lines[order], starts[order], ends[order]
    new_line = np.r_[True, lines[1:] != lines[:-1]]
    # Ends run on within a text: shift each text's numbers above those of the one before.
    shift = (np.cumsum(new_line) - 1) * (int(ends.max()) + 2)
    reach = np.maximum.accumulate(ends + shift)
    new = np.r_[True, starts[1:] + shift[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lines)) - 1
    return lines[first], starts[first], reach[last] - shift[last]


def _entries(rows: DataFrame, found: DataFrame, least: int, buckets: int) -> DataFrame:
    """Dictionary entries outside settled phrases (``trigger``, ``body``, ``line``, ``id``, ``start``, ``end``), and the settled places (no ``body``)."""

    def of(texts: pa.Table, known: pa.Table) -> pa.Table:
        found_lines, found_keys = _joined(known, TRIGGERS_FOUND, "lines"), _joined(known, TRIGGERS_FOUND, "keys")
        pairs = np.unique(_pair(found_lines, found_keys))
        lines, starts, ends = _merged(*(_joined(known, SETTLED, c) for c in ("lines", "starts", "ends")))
        some = np.unique(lines)
        of_line = np.searchsorted(some, lines)
        none = lambda kind: pa.nulls(len(lines), kind)
        out = [pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.binary()), pa.array(lines), none(pa.int64()), pa.array(starts), pa.array(ends)], ENTRY_COLUMNS)]
        for batch in texts.select(["line", "id", "text"]).to_batches():
            names, numbers, opened = batch.column(0).to_numpy(), batch.column(1).to_numpy(), unpacked(batch.column(2))
            for i, j in W.slices(opened):
                data = _Bytes(opened.slice(i, j - i))
                text, first, end, trigger = data.short_phrases(least)
                own = names[i + text]
                here, stop = first - data.starts[text], end - data.starts[text]
                open_ = np.isin(_pair(own, trigger_key(trigger, buckets)), pairs)
                if len(lines):
                    long = max(int(ends.max()), len(data.data)) + 1
                    number = np.minimum(np.searchsorted(some, own), len(some) - 1)
                    before = np.searchsorted(of_line * long + starts, number * long + here, side="right") - 1
                    held = np.maximum(before, 0)
                    open_ &= ~((some[number] == own) & (before >= 0) & (of_line[held] == number) & (stop <= ends[held]))
                at = np.flatnonzero(open_)
                body = [data.data[p:q].tobytes() for p, q in zip(first[at].tolist(), end[at].tolist())]
                columns = [pa.array(trigger[at].view(np.int64)), pa.array(body, pa.binary()), pa.array(own[at]), pa.array(numbers[i + text[at]]), pa.array(here[at]), pa.array(stop[at])]
                out.append(pa.RecordBatch.from_arrays(columns, ENTRY_COLUMNS))
        return pa.Table.from_batches(out)

    by_group = packed(rows.select("line", "id", "text")).withColumn("bucket", F.col("line") % buckets).groupBy("bucket")
    return by_group.cogroup(found.groupBy("bucket")).applyInArrow(of, "trigger long, body binary, line long, id long, start long, end long")


def _pair(lines: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(lines.astype(np.uint64)) + keys.astype(np.uint64))


def suffix_classes(data: np.ndarray, places: np.ndarray, least: int) -> np.ndarray:
    """Rank of the suffix at each of the places in the order of all, by its first ``least`` bytes; equal ones have one rank.

    Prefix doubling: ranks of 8 bytes, put together to 16, 32, ... and, overlapping, to ``least``.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    rank = sliding_window_view(padded, 8)[: len(data)].copy().view(">u8").ravel().astype(np.uint64)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    width = 8
    while width < least:
        step = min(width, least - width)
        ahead = np.concatenate([rank[step:], np.zeros(step, np.int64)])
        rank = np.unique(rank * (int(ahead.max(initial=0)) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        width += step
    return rank[places]


def _cold(entries: DataFrame, least: int) -> DataFrame:
    """Spans of the suffixes of a smaller id, triggers kept together: a dictionary of the distinct entries, its suffix array, and
    the places of the parse where they stand."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        coded = table.column("body").combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        lines, ids, starts, triggers = (table.column(c).to_numpy() for c in ("line", "id", "start", "trigger"))
        bodies = coded.dictionary.to_pylist()
        sizes = np.array([len(b) for b in bodies], dtype=np.int64)
        owner = np.full(len(bodies), np.iinfo(np.int64).max)
        np.minimum.at(owner, code, ids)
        trigger = np.zeros(len(bodies), np.int64)
        trigger[code] = triggers
        _, group, count = np.unique(trigger, return_inverse=True, return_counts=True)
        open_ = np.flatnonzero(count[group] > 1)
        later = np.flatnonzero(ids > owner[code])
        found = [(lines[later], starts[later], starts[later] + sizes[code[later]])]
        if len(open_):
            data = np.frombuffer(b"".join([bodies[k] for k in open_.tolist()]), dtype=np.uint8)
            counts = sizes[open_] - least + 1
            begins, before = np.cumsum(sizes[open_]) - sizes[open_], np.cumsum(counts) - counts
            body = np.repeat(np.arange(len(open_)), counts)
            inside = np.arange(counts.sum()) - np.repeat(before, counts)
            rank = suffix_classes(data, begins[body] + inside, least)
            first = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, rank, owner[open_][body])
            hit = np.flatnonzero(first[rank] < owner[open_][body])
            body, one, two = _merged(body[hit], inside[hit], inside[hit] + least)
            # The owner's own places of these entries.
            of_body = np.full(len(bodies), -1)
            of_body[open_] = np.arange(len(open_))
            mine = np.flatnonzero((ids == owner[code]) & (of_body[code] >= 0))
            low, high = (np.searchsorted(body, of_body[code[mine]], side=x) for x in ("left", "right"))
            n = high - low
            row = np.repeat(mine, n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            found.append((lines[row], starts[row] + one[at], starts[row] + two[at]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["line", "start", "end"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < ENTRIES:
                continue
            table = pa.Table.from_batches(held)
            triggers = table.column("trigger").to_numpy()
            change = np.flatnonzero(triggers[1:] != triggers[:-1])
            if len(change):
                cut = int(change[-1]) + 1
                yield spans(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = table.num_rows - cut
        if size:
            yield spans(pa.Table.from_batches(held))

    together = entries.repartition("trigger").sortWithinPartitions("trigger")
    return map_texts(together.select("trigger", "body", "line", "id", "start"), of, "line long, start long, end long")


def _later_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (``line``, ``start``, ``end``) of entries that a smaller id owns, and the owners' entries, which go on."""
    owners = _stored(entries.groupBy("trigger", "body").agg(F.min("id").alias("owner")), "owners")  # stored, so that Spark can split a large entry's rows
    own = F.col("id") == F.col("owner")
    joined = entries.join(owners, ["trigger", "body"])
    marked = _stored(joined.select(F.when(own, F.col("body")).alias("body"), "line", "id", "start", "end"), "marked")
    return marked.where("body IS NULL").select("line", "start", "end"), marked.where("body IS NOT NULL")


def _suffixes(entries: DataFrame, least: int) -> DataFrame:
    """The first ``least`` bytes of every suffix that begins in an entry, with its ``line``, ``id`` and ``start``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, starts = batch.column(0).to_pylist(), batch.column(3).to_numpy()
            sizes = np.array([len(b) for b in bodies], dtype=np.int64)
            counts = sizes - least + 1
            windows = sliding_window_view(np.frombuffer(b"".join(bodies), dtype=np.uint8), least)
            begins, before = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
            for i in range(0, int(counts.sum()), SUFFIXES):
                number = np.arange(i, min(i + SUFFIXES, int(counts.sum())))
                row = np.searchsorted(before, number, side="right") - 1
                inside = number - before[row]
                prefix = pa.FixedSizeBinaryArray.from_buffers(pa.binary(least), len(number), [None, pa.py_buffer(windows[begins[row] + inside].tobytes())]).cast(pa.binary())
                lines, ids = (batch.column(k).take(pa.array(row)) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([prefix, lines, ids, pa.array(starts[row] + inside)], ["prefix", "line", "id", "start"])

    return map_texts(entries.select("body", "line", "id", "start"), of, "prefix binary, line long, id long, start long")


def _later_suffixes(suffixes: DataFrame, least: int) -> DataFrame:
    """Spans of the suffixes whose class, those that begin with the same bytes, has a smaller id."""
    classes = suffixes.groupBy("prefix").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last")
    classes = _stored(classes.select("prefix", "owner"), "classes")
    later = suffixes.join(classes, "prefix").where("id > owner")
    return later.select("line", "start", (F.col("start") + least).alias("end"))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` as ``line`` (their key), ``id`` and ``text``, and per line with any the ``spans`` (starts and ends of bytes, possibly
    overlapping) that a string of ``least`` bytes of a smaller id covers."""
    if least < GRAM:
        raise ValueError(f"strings of fewer than {GRAM} bytes have no trigger")
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << 63) - 1)).alias("line"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    long = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= least))
    total = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + total // BUCKET_BYTES
    found = _answered(_asked(long, least, buckets), buckets)
    made = _stored(_entries(long, found, least, buckets), "entries")
    entries = made.where("body IS NOT NULL")
    hot = _stored(entries.groupBy("trigger").count().where(F.col("count") > HOT).select("trigger"), "hot")
    spans = _cold(without(entries, hot, "trigger"), least)
    if not hot.isEmpty():
        whole, open_ = _later_entries(only(entries, hot, "trigger"))
        spans = spans.unionByName(whole).unionByName(_later_suffixes(_stored(_suffixes(open_, least), "suffixes"), least))
    return rows, made.where("body IS NULL").select("line", "start", "end").unionByName(spans)


def kept_bytes(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every row."""
    lists = _stored(spans.groupBy("line").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "lists")  # one text's

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for text, given in zip(batch.column(1), batch.column(2)):
                data = opener.decompress(text.as_buffer())
                spans_ = given.values.flatten()
                one, two = (v.to_numpy() for v in spans_)
                _, one, two = _merged(np.zeros(len(one), np.int64), one, two)
                kept, at = hashlib.sha256(), 0
                view = memoryview(data)
                for p, q in zip(one.tolist(), two.tolist()):
                    kept.update(view[at:p])
                    at = q
                kept.update(view[at:])
                out.append((len(view), int((two - one).sum()), len(one), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    ids = lists.select("line")
    cut = map_texts(packed(only(rows, ids, "line")).join(lists, "line").select("id", "text", "spans"), of, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    whole = without(rows, ids, "line").select("id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    return whole.unionByName(cut)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_BYTES) -> DataFrame:
    return kept_bytes(*repeated_bytes(docs, id_col, text_col, least))
