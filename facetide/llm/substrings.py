"""Substring dedup: compact windows of token min-hashes, interval joins, verified passages.

Tokens are the ``SHINGLE``-word shingles of a text. For each of ``HASHES`` hash functions the text's Cartesian tree over the
token hashes is cut to the nodes that span at least ``least`` tokens: a node is the compact window (a, c, b), and every
subsequence within [a, b] that holds place c has its min-hash there. (Such nodes are the places that are the minimum of
some window of ``least`` tokens, so the tree is built over these few alone.) Windows of two texts with one
hash and one minimum stand for passages that agree in it. For two texts the tied windows that overlap are one region, in which
a passage may be shared; one window is enough, as an edit can leave a short passage no more. It is
then verified on the texts: the span of shared tokens (gaps of a few edited words are bridged) must be ``least`` tokens
long and, as a set, similar by ``percent`` or more in both texts.

A minimum that many texts share is never expanded into pairs. A least passage around place c reaches at least half its length to
one side, so windows are tied if, beside the minimum, some other evidence of a side (``SIDES``) is equal too: the token half a
passage away, or the minimum, by another hash function, of the half or the quarter passage next to c. A word put in or left out
shifts the token but seldom takes all of these minima. Each task ties its windows of one key to the first of them (before any shuffle), then one window a task goes by the key, and these are
tied to the first of all. Windows in no verified passage are tied anew among themselves, by their minimum and a token at each
side: a passage of ``least`` tokens around c holds c - l and c + r for some l + r >= least - 2 * step + 1 on a grid of
``step``, which gets finer (``STEPS``). Last, what is still open is tied by whole passages of ``least`` tokens. Every round also
ties by sketches for edited passages: pairs of minima, by hash functions of the round, of nearly a passage around c. So texts
that share a passage among themselves but not with the first one are found. Equal texts are found by a hash beforehand: the
first goes on alone, the others are reported as one passage each.

Defined cases: null, empty and short texts have no windows; null ids are dropped; a passage repeated within one text is
not reported; equal texts share one passage of their whole length; of equal passages the holder of the smallest id is
the kept one; columns other than id and text are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import words as W
from .shared import BROADCAST_ROWS, map_texts, only, packed, unpacked, without

HASHES = 4
SHINGLE = 5
LEAST_WORDS = 50
GAPS = (12, 6, 1)  # tokens a passage may lose at one place: two edited words close together, one, none
STEPS = (8, 4, 1)
SPANS_SENT = 250_000  # passages of 16 bytes that may go to the scans; more are joined by shuffle
GRID = 8  # tokens between the spans that are sketched around a minimum
SKETCHES = 2  # pairs of minima of a span and round
_SIDE = (1 << 16) - 1  # reach of a window to either side that is kept; a passage needs far less

SIDES = ("right", "left", "right_half", "left_half", "right_quarter", "left_quarter")
WINDOWS = "key long, right_left long, half long, quarter long, id long, place long, head long, head_place long"  # two sides in one number
PAIRS_AT_ONCE = 2_000  # texts tied to one head that a task verifies; more are split
BATCH = 50_000
WORKED = 10_000  # windows whose keys are made at once


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Places that are the minimum of some window of ``width`` values; the low bits of a value are its place."""
    n = len(values)
    if n < width:
        return values[:0]
    high = np.full(-n % width, np.iinfo(np.uint64).max, dtype=np.uint64)
    block = np.concatenate([values, high]).reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    change = np.ones(len(least), dtype=bool)
    change[1:] = least[1:] != least[:-1]
    return least[change]


def compact_windows(values: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, c, b of the Cartesian tree's nodes that span at least ``width`` places.

    ``bits`` low bits of every value are its place. A value below ``1 << bits`` divides two texts.
    """
    mask = np.uint64((1 << bits) - 1)
    place = np.unique(_window_minima(values, width) & mask).astype(np.int64)
    v = values[place]
    a = np.concatenate([[-1], place])[_smaller_before(v) + 1] + 1
    b = np.concatenate([[len(values)], place[::-1]])[_smaller_before(v[::-1]) + 1][::-1] - 1
    node = (v > mask) & (b - a + 1 >= width)
    return a[node], place[node], b[node]


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """The nearest place before each that has a smaller value, -1 if there is none; by jumps over what is known to be larger."""
    before = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero(before >= 0)
    while len(open_):
        at = before[open_]
        larger = values[at] > values[open_]
        open_ = open_[larger]
        before[open_] = before[at[larger]]
        open_ = open_[before[open_] >= 0]
    return before


def _place(k: int, a: np.ndarray, c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number of a window: place, reach to both sides, hash function."""
    return (c << 36) | (np.minimum(c - a, _SIDE) << 20) | (np.minimum(b - c, _SIDE) << 4) | k


def _opened(place: np.ndarray) -> tuple[np.ndarray, ...]:
    c = place >> 36
    return place & 15, c - ((place >> 20) & _SIDE), c, c + ((place >> 4) & _SIDE)


def _all_windows(bare: DataFrame, least: int) -> DataFrame:
    """Windows of all texts, to be tied by ``key`` and a side, and ties of those that an earlier window of their task can be the head of."""
    factors = W.odd_constants(HASHES, 11)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in batches:
            texts = W.as_large(batch.column(1))
            names = batch.column(0).to_numpy()
            for i, j in W.slices(texts):
                tokens, at = W.shingles(*W.word_hashes(texts.slice(i, j - i)), SHINGLE)
                tokens = np.insert(tokens, at[1:], 0)
                starts = at[:-1] + np.arange(j - i)
                divider = np.zeros(len(tokens), dtype=bool)
                divider[at[1:] + np.arange(j - i)] = True
                bits = max(1, int(len(tokens)).bit_length())
                here = np.arange(len(tokens), dtype=np.uint64)
                for k in range(HASHES):
                    hashed = W.mix(tokens * factors[k])
                    values = (hashed >> np.uint64(bits) << np.uint64(bits)) | np.uint64(1 << bits) | here
                    values[divider] = here[divider]
                    a, c, b = compact_windows(values, least, bits)
                    owner = np.searchsorted(starts, c, side="right") - 1
                    first = starts[owner]
                    sides = (x.astype(np.int32) for x in _sides(tokens, a, c, b, least))
                    found.append((W.mix(hashed[c] + np.uint64(k)).view(np.int64), *sides, names[i + owner], _place(k, a - first, c - first, b - first)))
        if found:
            key, *sides, ids, place = (np.concatenate(x) for x in zip(*found))
            found.clear()
            yield from _tied(key, sides, ids, place)

    return map_texts(bare.where("text IS NOT NULL").select("id", "text"), of, WINDOWS)


def _short(tokens: np.ndarray) -> np.ndarray:
    """31 bits of a token, never 0."""
    return (W.mix(tokens) >> np.uint64(33)).astype(np.int64) | 1


class _Least:
    """Least value of any range of up to ``longest`` places, from the least ones of ranges of 1, 2, 4, ... places."""

    def __init__(self, values: np.ndarray, longest: int):
        rows = [values]
        while 1 << len(rows) <= longest:
            before, step = rows[-1], 1 << (len(rows) - 1)
            rows.append(np.concatenate([np.minimum(before[:-step], before[step:]), before[-step:]]) if step < len(before) else before)
        self.table = np.stack(rows)

    def __call__(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        level = np.frexp(size.astype(np.float64))[1] - 1  # floor of the logarithm to base 2
        return np.minimum(self.table[level, low], self.table[level, low + size - (1 << level)])


def _sides(tokens: np.ndarray, a: np.ndarray, c: np.ndarray, b: np.ndarray, least: int) -> list[np.ndarray]:
    """Evidence beside each minimum, as in ``SIDES``; 0 where the window does not reach so far."""
    reach = (least - 1) // 2  # a passage of ``least`` tokens around c holds c + reach or c - reach
    right = np.where(c + reach <= b, _short(tokens[np.minimum(c + reach, len(tokens) - 1)]), 0)
    left = np.where(c - reach >= a, _short(tokens[np.maximum(c - reach, 0)]), 0)
    out = [right, left]
    for width, factor in zip((reach, max(1, reach // 2)), W.odd_constants(2, 13)):
        enough = max(1, width // 2)  # what an edit beside the end of a passage leaves
        least_of = _Least(W.mix(tokens * factor), width) if len(c) else None
        for forward, room in ((True, b - c), (False, c - a)):
            evidence = np.zeros(len(c), dtype=np.int64)
            far = np.flatnonzero(room >= enough)
            if len(far):
                size = np.minimum(width, room[far])
                evidence[far] = _short(least_of(c[far] + 1 if forward else c[far] - size, size))
            out.append(evidence)
    return out


def _tied(key: np.ndarray, sides: list[np.ndarray], ids: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of windows with one key and side the first goes on; the others are tied to it here."""
    goes_on = np.zeros(len(key), dtype=bool)
    ties = [np.zeros(0, np.int64)]
    in_order = np.lexsort((place, ids))
    low = np.uint64((1 << int(len(key)).bit_length()) - 1)  # bits of a hash that make room for the rank in this order, so that plain sorting keeps it
    for side, factor in zip(sides, W.odd_constants(len(sides), 19)):
        own = in_order[side[in_order] != 0]
        both = W.mix(key[own].view(np.uint64) + side[own].astype(np.uint64) * factor)
        own = own[(np.sort((both & ~low) | np.arange(len(own), dtype=np.uint64)) & low).astype(np.int64)]
        first = np.ones(len(own), dtype=bool)
        first[1:] = (key[own][1:] != key[own][:-1]) | (side[own][1:] != side[own][:-1])
        goes_on[own[first]] = True
        head = own[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))] if len(own) else own
        other = ids[own] != ids[head]
        ties.append(own[other] * len(key) + head[other])
    pairs = np.stack(np.divmod(np.unique(np.concatenate(ties)), max(len(key), 1)), axis=1)
    names = WINDOWS.replace(" long", "").split(", ")
    rows = np.flatnonzero(goes_on)
    for i in range(0, len(rows), BATCH):
        x = rows[i : i + BATCH]
        none = pa.nulls(len(x), pa.int64())
        twos = [one[x].astype(np.int64) | two[x].astype(np.int64) << 31 for one, two in zip(sides[::2], sides[1::2])]
        yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (key[x], *twos, ids[x], place[x])), none, none], names)
    for i in range(0, len(pairs), BATCH):
        x, h = pairs[i : i + BATCH, 0], pairs[i : i + BATCH, 1]
        spread, none = W.mix(place[x].view(np.uint64)).view(np.int64), pa.nulls(len(x), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(spread), none, none, none, *(pa.array(v) for v in (ids[x], place[x], ids[h], place[h]))], names)


def _first_ties(windows: DataFrame) -> DataFrame:
    """Ties of all texts: those made in the tasks, and of the windows that go by key to the first with the same side."""
    twos = [(name, SIDES[2 * k : 2 * k + 2]) for k, name in enumerate(("right_left", "half", "quarter"))]
    one_of = {side: F.col(name).bitwiseAND(F.lit((1 << 31) - 1)) if k == 0 else F.shiftright(name, 31) for name, pair in twos for k, side in enumerate(pair)}
    all_of = Window.partitionBy("key")
    several = F.min("id").over(all_of) != F.max("id").over(all_of)  # most keys are in one text only: these rows needn't be put in order by side
    by_key = windows.repartition("key").withColumn("several", several).where("several OR head IS NOT NULL").withColumns(one_of)
    first = lambda side: F.min(F.struct("id", "place")).over(Window.partitionBy("key", side))
    heads = by_key.withColumns({f"first_{side}": first(side) for side in SIDES})
    given = F.struct(F.col("head").alias("id"), F.col("head_place").alias("place"))
    some = lambda side: F.when((F.col(side) != 0) & F.col("head").isNull(), F.col(f"first_{side}"))
    tied = heads.select("id", "place", F.explode(F.array_distinct(F.array(*(some(side) for side in SIDES), F.when(F.col("head").isNotNull(), given)))).alias("first"))
    return tied.where("first IS NOT NULL AND id != first.id").select("id", "place", F.col("first.id").alias("head"), F.col("first.place").alias("head_place"))


def _ties(windows: DataFrame) -> DataFrame:
    """Windows of one key tied to the one of smallest id, texts with themselves not."""
    first = F.min(F.struct("id", "place")).over(Window.partitionBy("key")).alias("first")
    ties = windows.select("id", "place", first).where("id != first.id")
    return ties.select("id", "place", F.col("first.id").alias("head"), F.col("first.place").alias("head_place"))


def _runs(places: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """Where the runs of ascending ``places`` that are at most ``gap`` apart begin and end in them."""
    cuts = ((places[1:] - places[:-1] > gap).nonzero()[0] + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(places)])) if len(places) else []


def _ascending(values: np.ndarray) -> np.ndarray:
    """The distinct values."""
    out = np.sort(values)
    first = np.ones(len(out), dtype=bool)
    np.not_equal(out[1:], out[:-1], out=first[1:])
    return out[first]


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``ascending``."""
    if not len(ascending):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(ascending, values)
    return ascending[np.minimum(at, len(ascending) - 1)] == values


def _shared_spans(a: np.ndarray, b: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Spans [p, q] of tokens ``a`` and [r, s] of ``b`` that hold a common passage, with its similarity.

    A span too unlike as a whole is tried again in parts, cut at ever smaller gaps.
    """
    out = []
    shared = _among(a, np.sort(b)).nonzero()[0]
    if len(shared) == 0 or shared[-1] - shared[0] + 1 < least:
        return out
    todo = [(shared[i:j], 0) for i, j in _runs(shared, GAPS[0])]
    while todo:
        run, level = todo.pop()
        p, q = int(run[0]), int(run[-1])
        if q - p + 1 < least:
            continue
        one = _ascending(a[p : q + 1])
        if 100 * len(run) >= percent * len(one):  # else the shared tokens are too few, whatever is beside them in ``b``
            theirs = _among(b, one).nonzero()[0]
            i, j = max(_runs(theirs, GAPS[level]), key=lambda x: x[1] - x[0])
            r, s = int(theirs[i]), int(theirs[j - 1])
            two = _ascending(b[r : s + 1])
            common = int(np.count_nonzero(_among(two, one)))
            union = len(one) + len(two) - common
            if s - r + 1 >= least and 100 * common >= percent * union:
                out.append((p, q, r, s, common / union))
                continue
        if level + 1 < len(GAPS):
            todo.extend((run[i:j], level + 1) for i, j in _runs(run, GAPS[level + 1]))
    return sorted(out)


class _Slice:
    """Tokens of a slice's texts one after the other, and what the keys of their windows are made from, each made once."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens

    @functools.cached_property
    def sums(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.tokens * W._powers(W.BASE, len(self.tokens)))])

    def minima(self, width: int, factors: np.ndarray) -> list[np.ndarray]:
        """Least hash of the ``width`` tokens from each place on, by each function."""
        kept = self.__dict__.setdefault("kept", [])
        for factor in factors[len(kept) :]:
            least, reach = W.mix(self.tokens * factor), 1
            while 2 * reach <= width:
                least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
            kept.append(np.minimum(least[: max(0, len(least) - width + reach)], least[width - reach :]) if reach < width else least)
        return kept


def _verified(pairs: DataFrame, texts: DataFrame, least: int, percent: int, step: int) -> DataFrame:
    """Passages (``key`` null) of the tied texts, and the windows in none of them, with new keys."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs = np.zeros(0, np.uint64)
        for batch in batches:
            names, heads = batch.column(1), batch.column(0).to_numpy()
            places, head_places = (c.flatten().to_numpy() for c in batch.columns[2:4])
            _, lefts, centres, rights = _opened(places)
            _, head_lefts, _, head_rights = _opened(head_places)
            ends = np.cumsum(pc.fill_null(batch.column(2).value_lengths(), 0).to_numpy(zero_copy_only=False))
            texts = unpacked(batch.column(4))
            for i, j in W.slices(texts):
                tokens, at = W.shingles(*W.word_hashes(texts.slice(i, j - i)), SHINGLE)
                here, passages, left, waiting = _Slice(tokens), [], [], 0
                for r in range(i, j):
                    mine = tokens[at[r - i] : at[r - i + 1]]
                    if not names[r].is_valid:  # a head goes before the texts that are tied to it
                        theirs = mine
                        continue
                    name, head, own = names[r].as_py(), int(heads[r]), slice(ends[r - 1] if r else 0, ends[r])
                    spans, covered = _compared(mine, theirs, *(x[own] for x in (lefts, rights, head_lefts, head_rights)))
                    failed = places[own] if covered is None else places[own][~covered[centres[own]]]
                    passages.extend((name, head, p, q + SHINGLE, x, y + SHINGLE, like) for p, q, x, y, like in spans)
                    if step and len(failed):  # without a step, what shares a whole passage with the head has been verified
                        left.append((name, int(at[r - i]), failed))
                        waiting += len(failed)
                    if waiting > WORKED:
                        yield from _checked(passages, here, left)
                        passages, left, waiting = [], [], 0
                yield from _checked(passages, here, left)

    def _checked(passages: list[tuple], here: _Slice, left: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        yield _rows(passages, *(np.zeros(0, np.int64),) * 3)
        if left:
            sizes = [len(x) for *_, x in left]
            names, starts = (np.repeat(np.array(x, np.int64), sizes) for x in list(zip(*left))[:2])
            places = np.concatenate([x for *_, x in left])
            for i in range(0, len(places), WORKED):
                yield _rows([], *_rekeyed(here, *(x[i : i + WORKED] for x in (names, starts, places))))

    def _rows(passages: list[tuple], names: np.ndarray, keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        m, n = len(passages), len(keys)
        none = lambda size, kind=pa.int64(): pa.nulls(size, kind)
        kinds = [pa.int64()] * 6 + [pa.float64()]
        spans = [pa.array([x[f] for x in passages], kind) for f, kind in enumerate(kinds)]
        columns = [pa.concat_arrays(x) for x in ((none(m), pa.array(keys)), (spans[0], pa.array(names)), (none(m), pa.array(places)), *((x, none(n, x.type)) for x in spans[1:]))]
        return pa.RecordBatch.from_arrays(columns, ["key", "id", "place", "head", "start", "end", "head_start", "head_end", "similarity"])

    def _compared(a: np.ndarray, b: np.ndarray, *windows: np.ndarray) -> tuple[list, np.ndarray | None]:
        """Passages of two texts, and the tokens of the first that are in one, if any is."""
        spans: list = []
        order = np.argsort(windows[0], kind="stable")
        lows, highs, head_lows, head_highs = (x[order].tolist() for x in windows)
        i = 0
        while i < len(lows):  # windows that overlap are one region
            p, q, r, s = lows[i], highs[i], head_lows[i], head_highs[i]
            i += 1
            while i < len(lows) and lows[i] <= q:
                q, r, s = max(q, highs[i]), min(r, head_lows[i]), max(s, head_highs[i])
                i += 1
            found = _shared_spans(a[p : q + 1], b[r : s + 1], least, percent)
            spans.extend((p + x[0], p + x[1], r + x[2], r + x[3], x[4]) for x in found)
        if not spans:
            return spans, None
        covered = np.zeros(len(a) + 1, dtype=bool)
        for p, q, *_ in spans:
            covered[p : q + 1] = True
        return spans, covered

    def _rekeyed(here: _Slice, names: np.ndarray, starts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, new key, place of windows; ``starts`` are their texts' first tokens in the slice."""
        k, first, c, last = _opened(places)
        windows = k, first + starts, c + starts, last + starts
        found = [of(here, *windows) for of in (_sketched, _sided if step > 1 else _whole)]
        keys, own = (np.concatenate(x) for x in zip(*found))
        keys, names, places = keys.view(np.int64), names[own], places[own]
        mixed = W.mix(keys.view(np.uint64) + W.mix(places.view(np.uint64) + W.mix(names.view(np.uint64))))
        order = np.argsort(mixed, kind="stable")
        keys, names, places = keys[order], names[order], places[order]
        once = np.ones(len(keys), dtype=bool)
        once[1:] = (keys[1:] != keys[:-1]) | (places[1:] != places[:-1]) | (names[1:] != names[:-1])
        return names[once], keys[once], places[once]

    def _sketched(here: _Slice, k: np.ndarray, first: np.ndarray, c: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the minimum with pairs of minima of nearly a passage around it, whatever the places; and whose they are."""
        width = max(1, least - GRID + 1)  # a passage around c holds one of these spans
        lows = c[:, None] - np.arange(0, least, GRID)
        fits = (lows >= first[:, None]) & (lows + width - 1 <= last[:, None])
        own, low = np.nonzero(fits)[0], lows[fits]
        base = W.mix(here.tokens[c[own]] + k[own].astype(np.uint64))
        minima = [x[low] for x in here.minima(width, W.odd_constants(2 * SKETCHES, 17 + step))]
        keys = [W.mix(base + W.mix(one + two * np.uint64(W.BASE))) for one, two in zip(minima[::2], minima[1::2])]
        return np.concatenate(keys), np.tile(own, SKETCHES)

    def _sided(here: _Slice, k: np.ndarray, first: np.ndarray, c: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the minimum with a token on each side, and whose they are."""
        reach = max(0, least - 2 * step + 1)
        back = np.arange(0, reach + 1, step)
        lows, highs = c[:, None] - back, c[:, None] + -(-(reach - back) // step) * step
        fits = (lows >= first[:, None]) & (highs <= last[:, None])
        own, lows, highs = np.nonzero(fits)[0], lows[fits], highs[fits]
        a = here.tokens
        mine = W.mix(a[c[own]] + k[own].astype(np.uint64))
        return W.mix(mine + a[lows] * np.uint64(W.BASE) + a[highs] + (c[own] - lows).astype(np.uint64)), own

    def _whole(here: _Slice, k: np.ndarray, first: np.ndarray, c: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all passages of ``least`` tokens around the minimum, token by token, and whose they are."""
        lows = c[:, None] - np.arange(least)
        fits = (lows >= first[:, None]) & (lows + least - 1 <= last[:, None])
        own, lows = np.nonzero(fits)[0], lows[fits]
        return W.mix((here.sums[lows + least] - here.sums[lows]) * W._powers(W._INVERSE, len(here.tokens))[lows]), own

    # A head's text goes once to each task that verifies texts tied to it, in front of them.
    large = pairs.groupBy("head").count().where(F.col("count") > PAIRS_AT_ONCE)
    few = large.count() <= BROADCAST_ROWS
    parts = F.coalesce(F.ceil(F.col("count") / PAIRS_AT_ONCE), F.lit(1))
    dealt = pairs.join(F.broadcast(large) if few else large, "head", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts)).drop("count")
    mine = dealt.join(only(texts, pairs.select("id").distinct(), "id"), "id")
    heads = only(texts, pairs.select(F.col("head").alias("id")).distinct(), "id").withColumnRenamed("id", "head")
    theirs = dealt.select("head", "part").distinct().join(heads, "head")
    rows = mine.unionByName(theirs, allowMissingColumns=True).repartition("head", "part").sortWithinPartitions("head", "part", F.col("id").isNotNull())
    return map_texts(rows.select("head", "id", "places", "head_places", "text"), of, "key long, id long, place long, head long, start long, end long, head_start long, head_end long, similarity double")


def _pairs(ties: DataFrame) -> DataFrame:
    """The tied windows of two texts in one row."""
    pairs = ties.groupBy("id", "head").agg(F.collect_set(F.struct("place", "head_place")).alias("x"))  # windows of two texts
    return stored(pairs.select("id", "head", F.col("x.place").alias("places"), F.col("x.head_place").alias("head_places")), "pairs")


def _copies(bare: DataFrame, least_words: int) -> tuple[DataFrame, DataFrame]:
    """Passages of whole texts that an earlier row has equally, and the ids of those texts."""
    hashed = bare.where("text IS NOT NULL").groupBy("id").agg(F.min(F.md5(F.col("text").cast("binary"))).alias("hash"), F.max(F.md5(F.col("text").cast("binary"))).alias("other"))
    hashed = hashed.where("hash = other").select("id", "hash")  # an id with several texts is no copy
    first = hashed.groupBy("hash").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("hash", "head")
    later = stored(hashed.join(first, "hash").where("id > head").select("id", "head"), "copies")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.as_large(batch.column(1))
            counts = [np.diff(W.word_hashes(texts.slice(i, j - i))[1]) for i, j in W.slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))], ["id", "n"])

    counted = map_texts(only(bare, later.select("id"), "id"), of, "id long, n long").where(F.col("n") >= least_words).distinct()
    zero = F.lit(0).cast("long")
    return counted.join(later, "id").select("id", zero.alias("start"), F.col("n").alias("end"), "head", zero.alias("head_start"), F.col("n").alias("head_end"), F.lit(1.0).alias("similarity")), later.select("id")


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, percent: int = 80) -> DataFrame:
    """``id``, ``start``, ``end`` (words, end excluded) of passages that an earlier text holds, which is named with its
    place (``head``, ``head_start``, ``head_end``) and the ``similarity`` of the passages' shingle sets."""
    least = least_words - SHINGLE + 1
    bare = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    whole, later = _copies(bare, least_words)
    firsts = without(bare, later, "id")
    pairs = _pairs(_first_ties(_all_windows(firsts, least)))
    ids = pairs.select("id").union(pairs.select(F.col("head").alias("id"))).distinct()
    texts = stored(packed(only(firsts, ids, "id")).dropDuplicates(["id"]), "texts")
    passages: list[DataFrame] = [whole]
    for step in (*STEPS, 0):
        checked = stored(_verified(pairs, texts, least, percent, step), "checked")
        passages.append(checked.where("key IS NULL").drop("key", "place"))
        pairs = _pairs(_ties(checked.where("key IS NOT NULL").select("key", "id", "place").distinct()))
        if pairs.isEmpty():
            break
    out = passages[0]
    for x in passages[1:]:
        out = out.unionByName(x)
    return out.select("id", "start", "end", "head", "head_start", "head_end", "similarity").distinct()


def cut_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars: str | None = None) -> DataFrame:
    """``docs`` without the words of the passages; a text that loses nothing stays as it is.

    ``n_chars`` names a column that holds the number of characters and follows the cut.
    """
    few = passages.count() <= SPANS_SENT
    spans = passages.groupBy(F.col("id").alias("_passage_of")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))  # one text's
    names, text_at = docs.columns, docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_without(t, s) for t, s in zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist())]
            columns = [pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    def _without(text: str, spans: list[dict]) -> str:
        data, _ = W.buffer_of(W.as_large(pa.array([text])))
        starts, ends = W.word_bounds(data)
        keep = np.ones(len(data), dtype=bool)
        for s in spans:
            stop = int(ends[s["end"] - 1])
            while stop < len(data) - 1 and data[stop] == 0x20:
                stop += 1
            keep[int(starts[s["start"]]) : stop] = False
        return data[keep].tobytes().decode()[:-1]

    joined = docs.join(F.broadcast(spans) if few else spans, F.col(id_col) == F.col("_passage_of"), "left").drop("_passage_of")
    cut = map_texts(joined.where("_spans IS NOT NULL"), of, docs.schema)
    if n_chars:
        cut = cut.withColumn(n_chars, F.length(text_col).cast(docs.schema[n_chars].dataType))
    return cut.unionByName(joined.where("_spans IS NULL").drop("_spans"))
