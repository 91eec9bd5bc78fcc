"""Best-fit packing: token sequences of at most ``capacity`` ids, filled by bin completion.

Documents become token ids (one tokenizer file, a separator id at the end); only longer ones are cut, into
pieces of ``capacity`` ids and a shorter last one. Pieces are then dealt at random over groups and every group
packs its own: around its largest piece left, completions of the rest of the sequence are searched depth
first, largest piece first. A filling is dominated, and skipped, if it takes a smaller length where an unused larger
one fits and completes no less (equal lengths count once; as the last piece only the largest that fits is tried).
A branch is pruned when even all pieces left that fit, taken together, would leave no less waste than the incumbent, the
first of which is the plain best-fit filling; a filling without waste ends the search, as does
``NODES`` visited nodes, with the best incumbent kept. What remains of a group's badly filled sequences is
packed again with that of other groups, in ever fewer groups, so that the number of sequences that are not full
does not grow with the number of groups.

Defined cases: null texts are empty; an empty text is one piece of the separator alone; documents with equal ids are
packed one by one; rows keep their own pieces, ties between equal lengths go to the smaller id and piece;
an empty table gives no sequences.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import words as W
from .shared import map_texts

NODES = 400
PIECES_PER_GROUP = 20_000
FULL = 0.995  # sequences filled below this share are packed again
ODD_AT_ONCE = 1_000  # chunks that take all steps of the tokenizer, whose results are large
CHUNKS_REMEMBERED = 300_000  # tokenized words kept by a worker, about 50 MB; when more, those met least are forgotten


_PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u017f]+")  # no combining marks: their normal form is simply lower case


class _Places(dict):
    """Numbers of chunks; one not met before gets the next number and is noted as new."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        place = self[chunk] = len(self)
        self.new.append(chunk)
        return place


class Encoder:
    """Ids of texts as the tokenizer of the file gives them, with the ids of each blank-free chunk remembered.

    The tokenizer drops white space and never joins over it, so a text's ids are those of its chunks in
    order; chunks are cut at spaces and line ends only, everything else is left to the tokenizer. Plain chunks go
    to its merges directly, split by its own pattern; others through all its steps.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        self._split = regex.compile(steps[0]["pattern"]["Regex"] + "|\n").findall  # line ends are kept, as ends of chunks
        self._merge = self._whole.model.tokenize
        self._spelling = _byte_letters() | {0x0A: "\n"}
        self._places = _Places()
        self._ids, self._starts, self._known = array("I"), array("q", [0]), None
        self._met = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keeps the chunks met most, half of what is remembered at most; most chunks of large tables are met once."""
        met = self._met
        kept = np.argsort(-met, kind="stable")[: CHUNKS_REMEMBERED // 2]
        kept = np.sort(kept[met[kept] > 1])
        ids, starts = np.array(self._ids, dtype=np.uint32), np.array(self._starts, dtype=np.int64)
        sizes = np.diff(starts)[kept]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) + np.repeat(starts[:-1][kept] - ends[:-1], sizes)
        again = set(kept.tolist())
        chunks = [chunk for chunk, place in self._places.items() if place in again]  # in order of their places
        self._places = _Places()
        self._places.update(zip(chunks, range(len(chunks))))
        self._ids, self._starts, self._known = array("I", ids[at].tobytes()), array("q", ends.astype(np.int64).tobytes()), None
        self._met = met[kept] // 2  # so that chunks not met any more go with time

    def _learn(self, new: list[bytes]) -> None:
        chunks = [c.decode() for c in new]
        odd = [c for c in chunks if not _PLAIN.fullmatch(c) or "<|" in c]
        by_steps: dict[str, list[int]] = {}
        for i in range(0, len(odd), ODD_AT_ONCE):
            some = odd[i : i + ODD_AT_ONCE]
            by_steps.update((c, e.ids) for c, e in zip(some, self._whole.encode_batch_fast(some, add_special_tokens=False)))
        pieces = self._split("".join(c + "\n" for c in chunks if c not in by_steps).lower())
        distinct = list({*pieces} - {"\n"})
        spelt = "\n".join(distinct).encode().decode("latin-1").translate(self._spelling).split("\n")
        ids_of = {piece: [t.id for t in self._merge(letters)] for piece, letters in zip(distinct, spelt)}
        rest = iter(pieces)
        for chunk in chunks:
            if chunk in by_steps:
                self._ids.extend(by_steps[chunk])
            else:
                for piece in iter(rest.__next__, "\n"):
                    self._ids.extend(ids_of[piece])
            self._starts.append(len(self._ids))
        self._known = None

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all UTF-8 texts one after the other, and the n + 1 places where each text's start."""
        if len(self._places) > CHUNKS_REMEMBERED:
            self._forget()
        split = [text.replace(b"\n", b" ").split(b" ") for text in texts]
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        places = np.fromiter(map(self._places.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(sizes.sum()))
        if self._places.new:
            self._learn(self._places.new)
            self._places.new = []
            self._met = np.concatenate([self._met, np.zeros(len(self._places) - len(self._met), np.int32)])
        self._met += np.bincount(places, minlength=len(self._met)).astype(np.int32)
        if self._known is None:
            self._known = (np.array(self._ids, dtype=np.uint32), np.array(self._starts, dtype=np.int64))
        ids, starts = self._known
        each = starts[places + 1] - starts[places]
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.arange(ends[-1]) + np.repeat(starts[places] - ends[:-1], each)
        return ids[at], ends[np.concatenate([[0], np.cumsum(sizes)])]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def encoder(path: str) -> Encoder:
    """The worker's encoder for the file."""
    cache = W.worker_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, separator: int = 1, with_ids: bool = False) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``) of every piece of every document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            texts = W.as_large(batch.column(1))
            for i, j in W.slices(texts):
                ids, bounds = encode(texts.slice(i, j - i).cast(pa.large_binary()).to_pylist())
                yield _cut(batch.column(0).slice(i, j - i), ids, bounds)

    def _cut(names: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        out: list[tuple] = []
        for r in range(len(names)):
            own = np.append(ids[bounds[r] : bounds[r + 1]], np.uint32(separator)).astype("<u4")
            for p, start in enumerate(range(0, len(own), capacity)):
                part = own[start : start + capacity]
                out.append((r, p, start, len(part), zlib.crc32(part.tobytes()), part if with_ids else None))
        rows = pa.array([x[0] for x in out], pa.int64())
        columns = [names.take(rows), *(pa.array([x[k] for x in out], pa.int64()) for k in range(1, 5))]
        if with_ids:
            columns.append(pa.array([x[5].astype(np.int32) for x in out], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = bare.schema["id"].dataType.simpleString()
    return map_texts(bare, of, f"id {kind}, piece long, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def completed(lengths: np.ndarray, capacity: int, nodes: int = NODES) -> np.ndarray:
    """The number of the sequence of each piece."""
    order = np.argsort(-lengths, kind="stable")
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order[::-1].tolist():
        held[lengths[i]].append(i)
    left = [len(x) for x in held]
    below = list(range(capacity + 1))  # skips lengths without pieces for good, shortened as it is walked

    def largest(x: int) -> int:
        """The largest length up to ``x`` that is left."""
        while x > 0 and not left[x]:
            if held[x]:
                x -= 1  # all of them on the path of the search
                continue
            if below[x] == x:
                below[x] = x - 1
            if not held[below[x]]:
                below[x] = below[below[x]] if below[below[x]] != below[x] else max(below[x] - 1, 0)
            x = below[x]
        return x

    smallest = 1
    out = np.zeros(len(lengths), dtype=np.int64)
    number, remaining = 0, len(lengths)
    while remaining:
        first = largest(capacity)
        left[first] -= 1
        while remaining > 1 and smallest < capacity and not left[smallest]:
            smallest += 1
        chosen = [first, *_filling(capacity - first, largest, left, smallest, nodes)]
        left[first] += 1
        for x in chosen:
            left[x] -= 1
            out[held[x].pop()] = number
        remaining -= len(chosen)
        number += 1
    return out


def _usable(room: int, x: int, largest, left: list[int]) -> int:
    """The most of the room that pieces up to the length ``x`` can take, if they went together: all that is left of them."""
    total = 0
    while x and total < room:
        total += x * left[x]
        x = largest(x - 1)
    return min(total, room)


def _filling(gap: int, largest, left: list[int], smallest: int, nodes: int) -> list[int]:
    """Lengths that leave the least of the gap, as far as the search came."""
    best: list[int] = []
    waste = gap
    path: list[int] = []
    visited = 0
    # a stack of (room, longest length that may come next); lengths on the path are taken off ``left`` meanwhile
    stack = [(gap, gap)]
    while stack:
        room, longest = stack.pop()
        x = largest(min(room, longest)) if longest > 0 else 0
        if x and visited < nodes and waste > room - _usable(room, x, largest, left):
            visited += 1
            rest = room - x
            # as a last piece x dominates every shorter one; a shorter one is tried only if more fits beside it
            stack.append((room, x - 1 if rest >= smallest else min(x - 1, room - smallest)))
            path.append(x)
            left[x] -= 1
            if rest < waste:
                waste, best = rest, path.copy()
            stack.append((rest, x))
        elif stack:
            left[path.pop()] += 1
    while path:
        left[path.pop()] += 1
    return best


def pack(parts: DataFrame, capacity: int = 4096, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """``parts`` (from ``pieces``) with ``sequence_id`` and ``offset`` of every piece."""
    columns = parts.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)

    def of_round(number: int):
        def of(table: pa.Table) -> pa.Table:
            table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
            lengths = table["length"].to_numpy()
            sequence = completed(lengths, capacity)
            order = np.argsort(sequence, kind="stable")
            ends = np.cumsum(lengths[order])
            firsts = np.flatnonzero(np.diff(sequence[order], prepend=-1))
            offset = ends - lengths[order] - np.repeat((ends - lengths[order])[firsts], np.diff(np.append(firsts, len(order))))
            filled = np.bincount(sequence, lengths).astype(np.int64)[sequence[order]]
            base = (number << 56) + (int(table["group"][0].as_py()) << 24)
            table = table.take(pa.array(order)).select(columns)
            for name, values in (("sequence_id", base + sequence[order]), ("offset", offset), ("filled", filled)):
                table = table.append_column(name, pa.array(values, pa.int64()))
            return table

        return of

    kept: list[DataFrame] = []
    groups = None
    rest = parts
    while True:
        n = rest.count()
        now = max(1, -(-n // per_group))
        last = now == 1 or (groups is not None and 2 * now > groups)  # few left, or regrouping helps no more
        group = F.pmod(F.xxhash64("id", "piece", F.lit(len(kept))), F.lit(now)).alias("group")
        packed = rest.select(*columns, group).groupBy("group").applyInArrow(of_round(len(kept)), f"{fields}, sequence_id long, offset long, filled long")
        packed = stored(packed, "packed")
        if last:
            kept.append(packed)
            break
        good = F.col("filled") >= int(FULL * capacity)
        kept.append(packed.where(good))
        rest, groups = packed.where(~good).select(*columns), now
    out = kept[0]
    for x in kept[1:]:
        out = out.unionByName(x)
    return out.drop("filled")
