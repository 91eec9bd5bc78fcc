"""Benchmark decontamination by template canonicalisation.

Every word becomes a template word: one with a digit is the placeholder number (its trailing letters, if they are a
unit, a unit), a word of ``UNITS`` the placeholder unit, a word with a capital that does not begin a sentence the
placeholder name; any other its lower-case letters and digits without punctuation. Words that keep nothing are left out.
A copy may have other capitals than the item, so windows are matched as well with the words
themselves in place of the names, and count for the same window of the item.
Windows of ``WINDOW`` template words of texts and benchmark items are joined by hash. A text is contaminated by an item
if it holds at least ``percent`` of the item's distinct windows and the slots are consistent: where a window of
the text stands for one of the item, the words behind its placeholders pair up, and one word of the item must
always pair with the same word of the text and the reverse (``slots`` tells whether all pairs are equal words: a copy, or
renamed: a re-parameterised question). Where the places of the whole text together are not consistent, as with several copies
of other names and numbers or with passages that share some windows, each occurrence is judged alone: the places that follow
one another near a diagonal (text place minus item place). One that passes is enough. Items shorter than a window are one window of all their words.

The item side is a small table. Up to ``PROBED_WINDOWS`` windows (its size is counted first) it is sent to the scans, so that
no text is shuffled; beyond it the windows of texts and items are joined by shuffle, and candidate texts are verified
by the same function. No group is expanded into pairs: a common window yields one row per text and item.

Defined cases: null and empty texts and items match nothing; null ids are dropped; equal items match each on their
own; a text that is an item is contaminated by it; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import map_texts

WINDOW = 5
PROBED_WINDOWS = 1_000_000

# Words that are units of measure.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres percent dollar dollars euro euros cent cents "
    "mph kmh hz khz mhz w kw j kj v a"
).split()

NUMBER, UNIT, NAME = np.uint64(1), np.uint64(2), np.uint64(3)


class Templates(NamedTuple):
    """Template words of some texts one after the other; ``plain`` has no names, ``words`` hashes the words behind them."""

    words: np.ndarray
    templates: np.ndarray
    plain: np.ndarray
    bounds: np.ndarray


def _hashes(texts: list[str]) -> np.ndarray:
    return np.unique(W.word_hashes(W.as_large(pa.array(texts, pa.string())))[0])


def canonical(texts: pa.Array, units: np.ndarray) -> Templates:
    """Template words of all texts."""
    raw, _ = W.buffer_of(texts)
    lowered = pc.utf8_lower(texts)
    data, offsets = W.buffer_of(lowered)
    if not len(data):
        return Templates(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    starts, ends = W.word_bounds(data)
    digit = (data >= 0x30) & (data <= 0x39)
    letter = ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    kept = digit | letter
    rank = np.concatenate([[0], np.cumsum(kept)])
    compact = data[kept].astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(compact * W._powers(W.BASE, len(compact)))])
    first, last = rank[starts], rank[ends]
    words = W.mix((sums[last] - sums[first]) * W._powers(W._INVERSE, len(compact) + 1)[first] + (last - first).astype(np.uint64))
    digits = np.concatenate([[0], np.cumsum(digit)])
    number = digits[ends] > digits[starts]
    # a sentence begins with the text, a line, or after . ! ? (closing quotes and brackets aside)
    gap = np.concatenate([[0], np.cumsum(data == 0x0A)])
    line = np.ones(len(starts), dtype=bool)
    line[1:] = gap[starts[1:]] > gap[ends[:-1]]
    stop = np.isin(data[ends - 1], np.frombuffer(b".!?:", dtype=np.uint8))
    begins = line.copy()
    begins[1:] |= stop[:-1]
    begins[np.searchsorted(starts, offsets[:-1][offsets[:-1] <= (starts[-1] if len(starts) else -1)])] = True
    name = ~begins & _capital(raw, data, starts, ends, texts, lowered)
    plain = np.where(np.isin(words, units), UNIT, words)
    plain = np.where(number, NUMBER, plain)
    templates = np.where(name & ~number, NAME, plain)
    some = last > first
    counts = np.concatenate([[0], np.cumsum(some)])
    return Templates(words[some], templates[some], plain[some], counts[np.searchsorted(starts, offsets)])


def _capital(raw: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: pa.Array, lowered: pa.Array) -> np.ndarray:
    """Words whose first letter is a capital and whose others are not: an ordinary name."""
    if len(raw) != len(data):  # lower case of another length somewhere: look at each word
        upper = [w[:1].isupper() and not w[1:].isupper() for t in texts.to_pylist() for w in t.encode().split() for w in [w.decode()]]
        return np.array(upper, dtype=bool) if len(upper) == len(starts) else np.zeros(len(starts), dtype=bool)
    changed = np.concatenate([[0], np.cumsum(raw != data)])
    head = np.minimum(starts + np.where(data[starts] >= 0x80, 2, 1), ends)
    return (changed[head] > changed[starts]) & (changed[ends] == changed[head])


def _windows(t: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows, of the same without names, and where each text's start."""
    plain, at = W.shingles(t.plain, t.bounds, WINDOW, whole_if_short=True)
    return W.shingles(t.templates, t.bounds, WINDOW, whole_if_short=True)[0], plain, at


class Items(NamedTuple):
    """The benchmark: ids, template words, and the windows of all items, with and without names, sorted by hash; ``window`` tells
    an item's distinct windows apart."""

    ids: np.ndarray
    words: np.ndarray
    templates: np.ndarray
    bounds: np.ndarray
    distinct: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    window: np.ndarray


def prepared(ids: list[int], texts: list[str | None], units: np.ndarray) -> Items:
    t = canonical(W.as_large(pa.array(texts, pa.string())), units)
    grams, plain, at = _windows(t)
    item = np.repeat(np.arange(len(ids)), np.diff(at))
    place = np.arange(len(grams)) - np.repeat(at[:-1], np.diff(at))
    distinct = np.array([len(np.unique(grams[at[i] : at[i + 1]])) for i in range(len(ids))], dtype=np.int64)
    other = np.flatnonzero(plain != grams)
    hashes, whose = np.concatenate([grams, plain[other]]), np.concatenate([np.arange(len(grams)), other])
    order = np.argsort(hashes, kind="stable")
    whose = whose[order]
    return Items(np.array(ids, dtype=np.int64), t.words, t.templates, t.bounds, distinct, hashes[order], item[whose], place[whose], grams[whose])


def _hits(grams: np.ndarray, plain: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places whose window, with or without names, is one of the items'."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    known = lambda x: hashes[np.minimum(np.searchsorted(hashes, x), len(hashes) - 1)] == x
    return np.flatnonzero(known(grams) | known(plain))


def _matches(name: int, words: np.ndarray, grams: np.ndarray, plain: np.ndarray, hit: np.ndarray, items: tuple, percent: int) -> list[tuple]:
    """Rows of the items that one text holds."""
    ids, item_words, item_templates, bounds, distinct, hashes, item, place, window = items
    ats, wheres = [], []
    for some, of in ((hit, grams), (hit[plain[hit] != grams[hit]], plain)):
        low, high = np.searchsorted(hashes, of[some]), np.searchsorted(hashes, of[some], side="right")
        each = high - low
        ats.append(np.repeat(low - np.concatenate([[0], np.cumsum(each)])[:-1], each) + np.arange(each.sum()))
        wheres.append(np.repeat(some, each))
    at, where = np.concatenate(ats), np.concatenate(wheres)
    out = []
    for i in np.unique(item[at]):
        own = item[at] == i
        size = min(WINDOW, bounds[i + 1] - bounds[i])
        span = np.arange(size)
        needed = -(-percent * int(distinct[i]) // 100)
        for entries, places in _occurrences(at[own], where[own], place, needed, int(bounds[i + 1] - bounds[i])):
            found = len(np.unique(window[entries]))
            if found < needed:
                continue
            theirs = bounds[i] + place[entries]
            a, b = (places[:, None] + span).ravel(), (theirs[:, None] + span).ravel()
            slot = item_templates[b] <= 3
            # a placeholder repeated in both may pair by chance in other windows: the pairing most slots agree on must be one to one
            if slot.any() and not _consistent(item_words[b[slot]], words[a[slot]]):
                continue
            kind = "none" if not slot.any() else "equal" if (item_words[b[slot]] == words[a[slot]]).all() else "renamed"
            out.append((name, int(ids[i]), found, int(distinct[i]), int(places.min()), int(places.max()) + size, kind))
            break
    return out


def _occurrences(entries: np.ndarray, where: np.ndarray, place: np.ndarray, needed: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hits of one item to judge together: all of the text, then those of every diagonal that can hold enough.

    From a diagonal on, each item place takes the nearest text place to the diagonal of the place before it.
    """
    if len(entries) < needed:
        return
    yield entries, where
    order = np.argsort(where - place[entries], kind="stable")
    entries, where = entries[order], where[order]
    theirs = place[entries]
    diagonal = where - theirs
    starts, counts = np.unique(diagonal, return_counts=True)
    low, high = np.searchsorted(diagonal, starts - length), np.searchsorted(diagonal, starts + length, side="right")
    for k in np.argsort(-counts, kind="stable"):
        near = slice(low[k], high[k])
        if high[k] - low[k] < needed:
            continue
        at, by = diagonal[near], np.argsort(theirs[near], kind="stable")  # of one place by diagonal
        cuts = np.flatnonzero(np.diff(theirs[near][by])) + 1
        if len(cuts) + 1 < needed:
            continue
        chosen, now = [], int(starts[k])
        for same in np.split(by, cuts):
            nearest = same[np.argmin(np.abs(at[same] - now))]
            now = int(at[nearest])
            chosen.append(nearest)
        yield entries[near][chosen], where[near][chosen]


def _consistent(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether nearly all slots follow one pairing of words that is one to one."""
    pairs, counts = np.unique(np.stack([item, text], axis=1), axis=0, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    used: dict[int, int] = {}
    back: dict[int, int] = {}
    agreed = 0
    for k in order:
        x, y = int(pairs[k, 0]), int(pairs[k, 1])
        if used.setdefault(x, y) == y and back.setdefault(y, x) == x:
            agreed += counts[k]
    return 10 * agreed >= 9 * len(item)


SCHEMA = "id long, item_id long, n_found long, n_windows long, start long, end long, slots string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.string()]
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kinds[k]) for k in range(7)], names)


def _probe(docs: DataFrame, items, units: np.ndarray, percent: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value
        for batch in batches:
            names, texts = batch.column(0), W.as_large(batch.column(1))
            rows: list[tuple] = []
            for i, j in W.slices(texts):
                t = canonical(texts.slice(i, j - i), units)
                grams, plain, at = _windows(t)
                hits = _hits(grams, plain, known[5])
                owner = np.searchsorted(at, hits, side="right") - 1
                for r in np.unique(owner).tolist():
                    words = slice(t.bounds[r], t.bounds[r + 1])
                    own = hits[owner == r] - at[r]
                    rows.extend(_matches(names[i + r].as_py(), t.words[words], grams[at[r] : at[r + 1]], plain[at[r] : at[r + 1]], own, known, percent))
            yield _batch(rows)

    return map_texts(docs, of, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", percent: int = 80, probed: int = PROBED_WINDOWS) -> DataFrame:
    """``id``, ``item_id``, ``n_found`` of ``n_windows`` windows, ``start`` and ``end`` (template words), ``slots``."""
    spark = docs.sparkSession
    units = _hashes(UNITS)
    bare = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id IS NOT NULL")
    size = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first().n or 0
    if size <= probed:
        rows = items.collect()
        return _probe(bare, spark.sparkContext.broadcast(tuple(prepared([r.item_id for r in rows], [r.text for r in rows], units))), units, percent)
    return _joined(bare, items, units, percent)


def _joined(bare: DataFrame, items: DataFrame, units: np.ndarray, percent: int) -> DataFrame:
    """The same for a benchmark too large to send: windows joined by shuffle, then each text with its candidates."""

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.as_large(batch.column(1))
            for i, j in W.slices(texts):
                grams, plain, at = _windows(canonical(texts.slice(i, j - i), units))
                owner = np.repeat(np.arange(j - i), np.diff(at))
                named, sizes = W.distinct_in_texts(grams, at)
                other = np.flatnonzero(plain != grams)
                rows = np.concatenate([np.stack([np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(sizes)), named, named]), np.stack([owner[other].astype(np.uint64), plain[other], grams[other]])], axis=1)
                owner, gram, window = np.unique(rows, axis=1)
                owner = owner.astype(np.int64)
                names = batch.column(0).slice(i, j - i).to_numpy()[owner]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(gram.view(np.int64)), pa.array(window.view(np.int64)), pa.array(np.diff(sizes)[owner])], ["id", "gram", "window", "n"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, text, item, item_text in zip(*(c.to_pylist() for c in batch.columns)):
                known = prepared([item], [item_text], units)
                t = canonical(W.as_large(pa.array([text], pa.string())), units)
                grams, plain, _ = _windows(t)
                rows.extend(_matches(name, t.words, grams, plain, _hits(grams, plain, known.hashes), known, percent))
            yield _batch(rows)

    schema = "id long, gram long, window long, n long"
    known = map_texts(items.withColumnRenamed("item_id", "id"), grams_of, schema).withColumnRenamed("id", "item_id")
    grams = map_texts(bare, grams_of, schema).select("id", "gram")
    found = grams.join(known, "gram").groupBy("id", "item_id", "n").agg(F.count_distinct("window").alias("found")).where(F.col("found") * 100 >= F.col("n") * percent)
    both = found.select("id", "item_id").join(bare, "id").join(items.withColumnRenamed("text", "item_text"), "item_id")
    return map_texts(both.select("id", "text", "item_id", "item_text"), verified, SCHEMA)
