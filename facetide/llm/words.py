"""Words and shingles of many texts at once, as numpy hashes.

A word is ``[^\\x20\\x09-\\x0D]+`` (what ``bytes.split`` cuts at), A-Z lower-cased. A word's hash is a
polynomial over its bytes modulo 2**64 with an odd base, taken from running sums over the whole
buffer, then mixed; equal words have equal hashes in every task. Null texts have no words.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # text worked on at once; one longer text is still one slice

BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
U = np.uint64

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_AS_IS = np.arange(256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= MIX_1
    x ^= x >> U(27)
    x *= MIX_2
    x ^= x >> U(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U(1000 * seed)) * U(BASE)) | U(1)


def worker_cache() -> dict:
    """A place that lasts as long as the Python worker, for tables that are dear to make again."""
    return sys.modules.setdefault("facetide_worker_cache", types.ModuleType("facetide_worker_cache")).__dict__


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers, kept for the next slice unless a very long text made them large."""
    kept = worker_cache().get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, SLICE_BYTES + SLICE_BYTES // 2), base, dtype=np.uint64)
        kept[:1] = 1
        kept = np.multiply.accumulate(kept)
        if len(kept) <= 4 * SLICE_BYTES:
            worker_cache()[base] = kept
    return kept[:n]


_INVERSE = pow(BASE, -1, 1 << 64)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each, at least one row."""
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    yield from zip(cuts[:-1], cuts[1:])


def as_large(texts: pa.Array) -> pa.Array:
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return pc.fill_null(texts.cast(pa.large_string()), "")


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one blank after each, and the n + 1 places where they start."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    joined = pc.binary_join_element_wise(texts, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; the buffer ends with a blank."""
    word = np.empty(len(data) + 1, dtype=np.int8)
    word[0] = 0
    np.logical_not(_BLANK[data], out=word[1:].view(bool))
    step = np.diff(word)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return starts, ends


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the n + 1 places where each text's words start."""
    data, offsets = buffer_of(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    starts, ends = word_bounds(data)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(((_LOWER if lower else _AS_IS)[data] + U(1)) * _powers(BASE, len(data)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, bounds: np.ndarray, k: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each place on, and the places where each text's shingles start.

    A text of fewer words has none or, with ``whole_if_short``, its whole sequence as one.
    """
    n, counts = len(words), np.diff(bounds)
    factors = odd_constants(k, 7)
    grams = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        grams += words[j : j + len(grams)] * factors[j]
    each = np.maximum(counts - k + 1, 0)
    keep = np.ones(len(grams), dtype=bool)
    for j in range(1, k):  # places whose shingle would run into the next text
        over = bounds[1:] - j
        over = over[(over >= 0) & (over < len(grams))]
        keep[over] = False
    if not whole_if_short:
        return mix(grams[keep]), np.concatenate([[0], np.cumsum(each)])
    short = np.flatnonzero((counts > 0) & (counts < k))
    full = np.concatenate([[0], np.cumsum(each)])
    grams = mix(grams[keep])
    if len(short):
        own = np.array(
            [(words[bounds[i] : bounds[i + 1]] * factors[: counts[i]]).sum(dtype=np.uint64) + U(counts[i]) for i in short],
            dtype=np.uint64,
        )
        grams = np.insert(grams, full[short], mix(own))
        each[short] = 1
        full = np.concatenate([[0], np.cumsum(each)])
    return grams, full


def distinct_in_texts(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and where each text's start."""
    v = values.copy()
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        v[i:j].sort()
    first = np.ones(len(v), dtype=bool)
    first[1:] = v[1:] != v[:-1]
    first[bounds[:-1][bounds[:-1] < len(v)]] = True
    return v[first], np.concatenate([[0], np.cumsum(first)])[bounds]
