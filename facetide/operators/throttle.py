"""Rate limit: an event passes when enough time went by since the last one that passed."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import Body, Columns, Fold, State, before, bodies, fold_table
from .ordered import Bucketed


class Entries:
    """Follows, in one walk over sorted times, every chain a stretch can be entered by.

    A chain is the passed rows after some first passed row. All chains that pass at the same
    row are one from there on, so each row is added and taken off at most once.
    """

    def __init__(self, interval: float):
        self.interval = interval
        self.first: float | None = None
        self.open = True  # later rows may still be first passed rows
        self.chains: deque[tuple[float, list[float]]] = deque()  # (last passed, first passed ones)

    def see(self, time: float) -> None:
        if self.first is None:
            self.first = time
        merged: list[float] = []
        while self.chains and time - self.chains[0][0] >= self.interval:
            begun = self.chains.popleft()[1]
            merged, begun = (merged, begun) if len(merged) >= len(begun) else (begun, merged)
            merged.extend(begun)
        if self.open and not (self.chains and self.chains[-1][0] == time):
            merged.append(time)
            self.open = time - self.first < self.interval
        if merged:
            self.chains.append((time, merged))

    def table(self) -> list[tuple[float, float]]:
        """(entry, exit) sorted by entry; of neighbours with one exit only the last is listed."""
        pairs = sorted((entry, last) for last, begun in self.chains for entry in begun)
        return [p for p, after in zip(pairs, [*pairs[1:], None]) if after is None or after[1] != p[1]]


class ThrottleFold(Fold):
    """Marks the rows that pass. ``time`` is in seconds; the next slot starts at the passed row.

    Rows without a time never pass.
    """

    def __init__(self, keys: Sequence[str], time: str, ties: Sequence[str], interval: float):
        self.keys, self.order, self.inputs = tuple(keys), (time, *ties), ()
        self.outputs = T.StructType([T.StructField("passed", T.BooleanType())])
        self.time, self.interval = time, interval

    def start(self) -> State:
        return {"last": None}

    def run(self, state: State, rows: Columns, size: int) -> tuple[State, Columns]:
        times = np.asarray(rows[self.time], dtype="float64")
        timed = np.flatnonzero(~np.isnan(times))  # missing times sort to the ends
        at, stop = (int(timed[0]), int(timed[-1]) + 1) if timed.size else (0, 0)
        times, passed, last = times.tolist(), [False] * size, state["last"]
        while at < stop:
            if last is not None:
                reach = 1  # look ever further ahead, then back
                while at + reach < stop and times[at + reach - 1] - last < self.interval:
                    at, reach = at + reach, 2 * reach
                at = bisect_left(times, True, at, min(at + reach, stop), key=lambda time: time - last >= self.interval)
                if at == stop:
                    break
            passed[at] = True
            last = times[at]
            at += 1
        return {"last": last}, {"passed": passed}

    def heads(self, parts: Bucketed) -> DataFrame:
        interval, time = self.interval, self.time
        compose = lambda a, b: composed(a, b, interval)

        def sum_up(state: State, rows: Columns, size: int) -> tuple[State, Body]:
            followed = Entries(interval)
            for value in np.asarray(rows[time], dtype="float64").tolist():
                if value == value:
                    followed.see(value)
            return state, {"first": followed.first, "pairs": [list(pair) for pair in followed.table()]}

        return before(bodies(parts, self, sum_up, compose), parts.keys, compose)

    def enter(self, state: State, head: Body) -> State:
        return {"last": leave(head["pairs"], None, self.interval)}


def leave(pairs: list[list[float]], last: float | None, interval: float) -> float | None:
    """The last passed row after a stretch that was entered with ``last``."""
    at = 0 if last is None else bisect_left(pairs, True, key=lambda pair: pair[0] - last >= interval)
    return pairs[at][1] if at < len(pairs) else last


def composed(a: Body, b: Body, interval: float) -> Body:
    """Two neighbouring stretches as one: entries of the first end where the second leaves them; what passes none of the
    first enters at the second. No entry lies behind the first one that is an interval after the beginning."""
    if a["first"] is None:
        return b
    pairs = [[entry, leave(b["pairs"], last, interval)] for entry, last in a["pairs"]]
    if not pairs or pairs[-1][0] - a["first"] < interval:
        reach = next((i + 1 for i, (entry, _) in enumerate(b["pairs"]) if entry - a["first"] >= interval), len(b["pairs"]))
        pairs += b["pairs"][:reach]
    return {"first": a["first"], "pairs": pairs}


def throttle(
    events: DataFrame,
    time: str,
    interval: float,
    keys: Sequence[str] = ("source_id",),
    ties: Sequence[str] = ("frame_id", "face_id"),
    span: float | None = None,
) -> DataFrame:
    """The events that pass. By default the limit is per source, so of several faces in one
    frame only the first passes; put ``face_id`` in ``keys`` to limit each face alone."""
    timed = events.where(F.col(time).isNotNull() & ~F.isnan(time))  # the others never pass
    if interval <= 0:
        return timed
    marked = fold_table(timed, ThrottleFold(keys, time, ties, interval), span)
    return marked.where("passed").drop("passed")
