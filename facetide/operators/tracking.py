"""Track numbers for boxes: each box goes to the live track it overlaps most, in order."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LiveSettings
from ..session import stored
from .folds import BODY, HEAD, Body, Columns, Fold, State, bodies, fold_table, running
from .ordered import BUCKET, Bucketed, bucket_number, join_alike

SECONDS = 60.0  # of a bucket: many times a track's life
MOMENTS = 10  # lives of a track at the end of a bucket from which the tracks at hand are guessed
SLICE = 8192  # boxes compared at once
CROWD = 64  # earlier boxes in reach of a box, on average, from which on boxes are compared with the tracks one after the other
EXACT = 2**25  # whole numbers below it are compared as doubles: products and sums of areas stay exact

# A track in a state: its number, its box, when it was last seen, and the box it took in the
# current frame (None if none yet). A track that has taken a box is not matched again before
# the next frame, and later boxes of the frame are compared with the box it had before.
ID, BOX, SEEN, TAKEN = range(4)


def best_overlap(box: Sequence[int], tracks: list[list]) -> tuple[float, list | None, list[list]]:
    """The largest overlap (intersection over union) of ``box`` with tracks that have not taken
    a box, the first track that has it, and the others that have it too."""
    left, top, wide, high = box
    right, bottom, area = left + wide, top + high, wide * high
    best, found, equals = 0.0, None, []
    for track in tracks:
        x, y, w, h = track[BOX]
        if track[TAKEN] is not None or x >= right or y >= bottom or x + w <= left or y + h <= top:
            continue
        across = (right if right < x + w else x + w) - (left if left > x else x)
        down = (bottom if bottom < y + h else y + h) - (top if top > y else y)
        shared = across * down
        overlap = shared / (area + w * h - shared)
        if overlap > best:
            best, found, equals = overlap, track, []
        elif overlap == best:
            equals.append(track)
    return best, found, equals


class TrackFold(Fold):
    """Track number per box. A frame is all rows of a key with one (time, frame).

    A bucket's boxes can be followed before its true tracks are known: from tracks at hand that are only guessed, numbered -1,
    -2, ... from the oldest, new ones 1, 2, ... Tracks live for a short time, so a guess soon makes no difference. ``heads``
    follows the last moments of each bucket from no tracks at all, all buckets from what that gave, then those again
    whose guess was not what the buckets before lead to, until every guess was right. A choice between two tracks at hand that
    overlap a box equally rests on their age; such a bucket (tied) must have been followed with their true order too.
    """

    def __init__(
        self,
        keys: Sequence[str] = ("source_id",),
        time: str = "ts",
        frame: str = "frame_id",
        number: str = "det_no",
        settings: LiveSettings = LiveSettings(),
    ):
        self.keys, self.order = tuple(keys), (time, frame, number)
        self.inputs = ("x", "y", "w", "h")
        self.outputs = T.StructType([T.StructField("track_id", T.LongType())])
        self.ttl, self.least = settings.ttl_seconds, settings.match_overlap

    def start(self) -> State:
        return {"tracks": [], "frame": None, "next": 1, "tied": False}

    def run(self, state: State, rows: Columns, size: int) -> tuple[State, Columns]:
        """Slice by slice. A track's box is one of the boxes before, so where few of them are in reach all their overlaps are
        worked out at once; a crowd of boxes in reach is walked box by box with the tracks at hand. Both give the same."""
        times = rows[self.order[0]]
        numbers = [np.empty(0, dtype="int64")]
        for begin in range(0, size, SLICE):
            end = min(begin + SLICE, size)
            part = {name: values[begin:end] for name, values in rows.items()}
            first = self._first_in_reach(times[begin:end], len(state["tracks"]))
            state, made = self._walk(state, part) if first is None else self._match(state, part, first)
            numbers.append(made)
        return state, {"track_id": np.concatenate(numbers)}

    def _first_in_reach(self, times: np.ndarray, tracks: int) -> np.ndarray | None:
        """For each row the first one whose track may be alive, a little early at most; None if rows are crowded or a time is no number."""
        if times.dtype.kind not in "iuf" or np.isnan(times[0]) or np.isnan(times[-1]):
            return None
        first = np.searchsorted(times, self._reach(times))
        size = len(times)
        return None if int(np.arange(size).sum() - first.sum()) + size * tracks > size * CROWD else first

    def _reach(self, times: np.ndarray) -> np.ndarray:
        return times - self.ttl - 1e-9 * (np.abs(times) + self.ttl)

    def _walk(self, state: State, rows: Columns) -> tuple[State, np.ndarray]:
        tracks = [list(track) for track in state["tracks"]]
        current, following, tied = state["frame"], state["next"], state["tied"]
        times, frames = rows[self.order[0]].tolist(), rows[self.order[1]].tolist()
        boxes = zip(*[rows[side].tolist() for side in self.inputs])
        numbers = []
        for time, frame, box in zip(times, frames, boxes):
            if current != [time, frame]:
                tracks = self._next_frame(tracks, current, time)
                current = [time, frame]
            best, found, equals = best_overlap(box, tracks)
            if equals and best >= self.least:
                tied = tied or any(t[ID] < 0 and found[ID] < 0 and t[1:] != found[1:] for t in equals)
            if found is None or best < self.least:
                found = [following, list(box), time, None]
                tracks.append(found)
                following += 1
            found[TAKEN] = list(box)
            numbers.append(found[ID])
        return {"tracks": tracks, "frame": current, "next": following, "tied": tied}, np.array(numbers, dtype="int64")

    def _match(self, state: State, rows: Columns, first: np.ndarray) -> tuple[State, np.ndarray]:
        """``_walk`` with the overlaps worked out beforehand. Boxes (of the tracks at hand, then of the rows) are told by their
        places: a box is free until a later one continues its track, and the place of a track's first box tells its age."""
        tracks, tied, current = state["tracks"], state["tied"], state["frame"]
        known, size = len(tracks), len(first)
        times, frames = rows[self.order[0]], rows[self.order[1]]
        opens = np.ones(size, dtype=bool)
        opens[1:] = (times[1:] != times[:-1]) | (frames[1:] != frames[:-1])
        opens[0] = current != [times[:1].tolist()[0], frames[:1].tolist()[0]]
        # 0 is the frame the state is in; boxes its tracks took there count from the next one on.
        frame = np.concatenate([[0 if track[TAKEN] is not None else -1 for track in tracks], np.cumsum(opens)]).astype("int64")
        at_hand = [(track[BOX], track[SEEN]) if track[TAKEN] is None else (track[TAKEN], current[0]) for track in tracks]
        seen = np.concatenate([np.array([time for _, time in at_hand], dtype=times.dtype if known == 0 else None), times])
        x, y, w, h = sides = [_exact(np.concatenate([np.array([box[i] for box, _ in at_hand], dtype=rows[side].dtype if known == 0 else None), rows[side]])) for i, side in enumerate(self.inputs)]
        ends_x, ends_y, area = x + w, y + h, w * h

        # All pairs of a box and an earlier one (a track at hand, or a row of an earlier frame) that may be alive then.
        near = int(np.searchsorted(self._reach(times), seen[:known].max(), side="right")) if known else 0
        start = np.maximum.accumulate(np.where(opens, np.arange(size), 0))
        counts = np.maximum(start - first, 0)
        before = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum()) + known
        a = np.concatenate([np.tile(np.arange(known), near), before])
        b = np.concatenate([np.repeat(np.arange(near), known), np.repeat(np.arange(size), counts)]) + known
        touch = ~((x[a] >= ends_x[b]) | (y[a] >= ends_y[b]) | (ends_x[a] <= x[b]) | (ends_y[a] <= y[b]))
        a, b = a[touch], b[touch]
        alive = (seen[b] - seen[a] <= self.ttl) & (frame[a] < frame[b])
        a, b = a[alive], b[alive]
        right, bottom, left, top = ends_x[b], ends_y[b], x[b], y[b]
        across = np.where(right < ends_x[a], right, ends_x[a]) - np.where(left > x[a], left, x[a])
        down = np.where(bottom < ends_y[a], bottom, ends_y[a]) - np.where(top > y[a], top, y[a])
        shared = across * down
        overlap = (shared / (area[b] + area[a] - shared)).astype("float64")
        enough = (overlap >= self.least) & (overlap > 0.0)
        a, b, overlap = a[enough], b[enough], overlap[enough]
        order = np.lexsort((-overlap, b))
        a, b, overlap = a[order], b[order], overlap[order]
        equal = np.append((b[1:] == b[:-1]) & (overlap[1:] == overlap[:-1]), False).tolist()  # to the next pair

        eldest = list(range(known + size))
        after = [0] * (known + size)  # the box that continues a box's track; place 0 continues none
        earlier, done = a.tolist(), -1
        for i, here in enumerate(b.tolist()):
            found = earlier[i]
            if here == done or after[found]:
                continue
            if equal[i]:
                j, others = i, [found]
                while equal[j]:
                    j += 1
                    if not after[earlier[j]]:
                        others.append(earlier[j])
                found = min(others, key=eldest.__getitem__)
                tied = tied or any(
                    eldest[other] < known and tracks[eldest[other]][ID] < 0 and eldest[found] < known and tracks[eldest[found]][ID] < 0
                    and any(values[other] != values[found] for values in (*sides, seen))
                    for other in others
                )
            after[found], eldest[here], done = here, eldest[found], here

        roots = np.array(eldest[known:], dtype="int64")
        new = roots == np.arange(known, known + size)
        ids = np.concatenate([np.array([track[ID] for track in tracks], dtype="int64"), state["next"] - 1 + np.cumsum(new)])
        numbers = ids[roots]

        # Tracks at hand after the last row, oldest first.
        last, moment = int(frame[-1]), times[-1]
        left_over = []
        for place in [*range(known), *range(known + int(first[-1]), known + size)]:
            mine = place < known
            if frame[place] == last:  # a box of the frame itself
                if mine:
                    left_over.append((place, list(tracks[place])))
                elif new[place - known]:
                    box = self._box(rows, place - known)
                    left_over.append((place, [int(ids[place]), box, moment.item(), list(box)]))
                continue
            took = after[place]
            if frame[took] == last if took else last == 0 or moment - seen[place] <= self.ttl:
                box, time = (list(at_hand[place][0]), at_hand[place][1]) if mine else (self._box(rows, place - known), times[place - known].item())
                left_over.append((eldest[place], [int(ids[eldest[place]]), box, time, self._box(rows, took - known) if took else None]))
        left_over.sort(key=lambda aged: aged[0])
        frame_at = [moment.item(), frames[-1:].tolist()[0]]
        after_all = {"tracks": [track for _, track in left_over], "frame": frame_at, "next": state["next"] + int(new.sum()), "tied": tied}
        return after_all, numbers

    def _box(self, rows: Columns, place: int) -> list:
        return [rows[side][place : place + 1].tolist()[0] for side in self.inputs]

    def _next_frame(self, tracks: list, current: list | None, time: float) -> list:
        live = []
        for number, box, seen, taken in tracks:
            if taken is not None:
                box, seen = taken, current[0]
            if time - seen <= self.ttl:
                live.append([number, box, seen, None])
        return live

    def heads(self, parts: Bucketed) -> DataFrame:
        time = self.order[0]

        def sum_up(state: State, rows: Columns, size: int) -> tuple[State, Body]:
            begun = state.get("begun")
            if begun is None:
                first = float(rows[time][0])
                live = self._next_frame(state["tracks"], None, first)
                state = {**state, "tracks": [[-place - 1, *track[1:]] for place, track in enumerate(live)]}
                begun = {"first": first, "start": [track[1:3] for track in state["tracks"]]}
            after, _ = self.run(state, rows, size)
            return {**after, "begun": begun}, {**begun, "tracks": after["tracks"], "frame": after["frame"], "new": after["next"] - 1, "tied": after["tied"]}

        newest = lambda a, b: b  # noqa: E731  (a later stretch's body holds for all of the bucket)
        soon = bucket_number(F.col(time) + MOMENTS * self.ttl, parts.rows.schema[time].dataType, parts.span)
        ends = bodies(replace(parts, rows=parts.rows.where(soon > F.col(BUCKET))), self, sum_up, newest)
        table = stored(bodies(parts, self, sum_up, newest, self._guesses_after(ends, parts)), "followed")
        while True:
            chain = stored(running(table, parts.keys, self.go_on), "chain")
            stale = stored(self._wrong_guesses(table, chain, parts), "guesses")
            if stale.isEmpty():
                return chain
            again = join_alike(parts.rows, stale.select(*parts.place), parts.place, "left_semi")
            followed = bodies(replace(parts, rows=again), self, sum_up, newest, stale)
            table = stored(join_alike(table, stale.select(*parts.place), parts.place, "left_anti").unionByName(followed), "followed")

    def _guesses_after(self, ends: DataFrame, parts: Bucketed) -> DataFrame:
        """(keys, BUCKET, HEAD) of the buckets next to those that end so."""
        names = list(parts.place)

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                heads = []
                for body in map(json.loads, batch.column(BODY).to_pylist()):
                    live = self._next_frame(body["tracks"], body["frame"], body["frame"][0])
                    heads.append(json.dumps({"guess": [track[1:3] for track in live]}))
                yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(heads, pa.string())], [*names, HEAD])

        made = ends.mapInArrow(work, T.StructType([*(ends.schema[n] for n in names), T.StructField(HEAD, T.StringType())]))
        return made.withColumn(BUCKET, F.col(BUCKET) + 1)

    def _wrong_guesses(self, table: DataFrame, chain: DataFrame, parts: Bucketed) -> DataFrame:
        """(keys, BUCKET, HEAD) of the buckets to follow again, with what the buckets before lead to."""
        names = list(parts.place)
        both = join_alike(table, chain, names, "inner").select(*names, BODY, HEAD)

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, heads = [], []
                for i in range(batch.num_rows):
                    body, known = json.loads(batch.column(BODY)[i].as_py()), json.loads(batch.column(HEAD)[i].as_py())
                    live = self.at_hand(known, body["first"])
                    if not self.guessed(body, live):
                        rows.append(i)
                        heads.append(json.dumps({"guess": [track[1:3] for track in live]}))
                kept = batch.select(names).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(heads, pa.string())], [*names, HEAD])

        return both.mapInArrow(work, T.StructType([*(both.schema[n] for n in names), T.StructField(HEAD, T.StringType())]))

    def at_hand(self, known: Body, time: float) -> list:
        """Tracks that are alive at ``time``, oldest first."""
        return sorted(self._next_frame(known["tracks"], known["frame"], time))

    def guessed(self, body: Body, live: list) -> bool:
        """Was the bucket followed from these tracks?"""
        boxes = [list(track[1:3]) for track in live]
        return boxes == body["start"] if body["tied"] else sorted(boxes) == sorted(body["start"])

    def go_on(self, known: Body, body: Body) -> Body:
        """What a bucket leads to from the true tracks ``known``: its own tracks with their true numbers.

        The first bucket of a key needs none. After a wrong guess only the boxes hold, until the bucket is followed again.
        """
        live = self.at_hand(known, body["first"])
        shift = known["new"]
        numbers = [track[ID] for track in live]
        if sorted(list(track[1:3]) for track in live) == sorted(body["start"]):
            place = {at: numbers[own] for at, own in zip(_by_boxes(body["start"]), _by_boxes([track[1:3] for track in live]))}
        else:
            place = {at: -1 - at for at in range(len(body["start"]))}
        tracks = [[place[-track[ID] - 1] if track[ID] < 0 else track[ID] + shift, *track[1:]] for track in body["tracks"]]
        return {"tracks": tracks, "frame": body["frame"], "new": body["new"] + shift}

    def enter(self, state: State, head: Body) -> State:
        if "guess" in head:
            tracks = [[-place - 1, box, seen, None] for place, (box, seen) in enumerate(head["guess"])]
            return {**self.start(), "tracks": tracks}
        return {"tracks": sorted(head["tracks"]), "frame": head["frame"], "next": head["new"] + 1, "tied": False}


def _exact(values: np.ndarray) -> np.ndarray:
    """Numbers whose products and quotients are those of Python's own."""
    if values.dtype.kind == "f":
        return values.astype("float64")
    if values.dtype.kind in "iu" and (not len(values) or -EXACT < int(values.min()) and int(values.max()) < EXACT):
        return values.astype("float64")
    return values.astype(object)


def _by_boxes(tracks: list) -> list[int]:
    """Places of (box, last seen) in an order given by them; equal ones oldest first."""
    return sorted(range(len(tracks)), key=lambda place: (tracks[place], place))


def assign_tracks(
    boxes: DataFrame,
    keys: Sequence[str] = ("source_id",),
    time: str = "ts",
    frame: str = "frame_id",
    number: str = "det_no",
    settings: LiveSettings = LiveSettings(),
    span: float | None = None,
) -> DataFrame:
    """``boxes`` (x, y, w, h per source, time in seconds, frame and box number) with ``track_id``.

    Track numbers count up from 1 per source. A track unseen for longer than its time to live
    is gone.
    """
    return fold_table(boxes, TrackFold(keys, time, frame, number, settings), span or SECONDS)
