"""Label smoothing of a face track: fading average, majority vote, switch with hysteresis."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LiveSettings
from ..session import stored
from .folds import Body, Columns, Fold, State, before, bodies, fold_table
from .ordered import Bucketed, trailing

FADED_AT_ONCE = 64  # rows whose averages are one matrix product


_WEIGHTS: dict[float, tuple[np.ndarray, np.ndarray]] = {}


def _weights(alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each row in the average after each of FADED_AT_ONCE rows, and of the average before them."""
    if alpha not in _WEIGHTS:
        ages = np.subtract.outer(np.arange(FADED_AT_ONCE), np.arange(FADED_AT_ONCE))
        rows = np.where(ages >= 0, alpha * (1.0 - alpha) ** np.maximum(ages, 0), 0.0)
        _WEIGHTS[alpha] = rows, (1.0 - alpha) ** np.arange(1, FADED_AT_ONCE + 1)
    return _WEIGHTS[alpha]


def fade(average: np.ndarray | None, probs: np.ndarray, alpha: float) -> np.ndarray:
    """The fading average after each row of ``probs``; the first row of a track stands as is."""
    out = np.empty(probs.shape, dtype="float64")
    done = 0
    if average is None and len(probs):
        average = out[0] = probs[0]
        done = 1
    weights, left = _weights(alpha)
    while done < len(probs):
        rows = probs[done : done + FADED_AT_ONCE]
        k = len(rows)
        if np.isfinite(rows).all():
            out[done : done + k] = weights[:k, :k] @ rows + left[:k, None] * average
        else:  # a product would carry such values back in time
            for i, row in enumerate(rows):
                average = out[done + i] = alpha * row + (1.0 - alpha) * average
        average = out[done + k - 1]
        done += k
    return out


class Fading:
    """A stretch of rows as the affine map it is to the average: e -> decay ** n * e + rest.

    A body is [n, rest, the first row]. Before its first row a track's average counts as that row.
    """

    def __init__(self, alpha: float):
        self.alpha = alpha

    def sum_up(self, probs: np.ndarray) -> Body:
        rest = fade(np.zeros(probs.shape[1]), probs, self.alpha)[-1]
        return [len(probs), rest.tolist(), probs[0].tolist()]

    def compose(self, a: Body, b: Body) -> Body:
        kept = (1.0 - self.alpha) ** b[0]
        return [a[0] + b[0], [kept * x + y for x, y in zip(a[1], b[1])], a[2]]

    def average(self, body: Body) -> list[float]:
        kept = (1.0 - self.alpha) ** body[0]
        return [kept * x + y for x, y in zip(body[2], body[1])]


def vote(window: deque, label: str) -> str:
    """Most frequent label of the window after adding ``label``; a tie goes to the newest."""
    window.append(label)
    counts = Counter(window)
    most = max(counts.values())
    return next(seen for seen in reversed(window) if counts[seen] == most)


class SwitchState(NamedTuple):
    stable: str | None = None
    score: float | None = None
    pending: str | None = None
    seen: int = 0


def switch(state: SwitchState, label: str, score: float, min_score: float, confirm: int) -> SwitchState:
    """The displayed label after a candidate: it changes only after repeated confirmation."""
    if state.stable is None or label == state.stable:
        return SwitchState(label, score)
    if score < min_score:  # a weak candidate leaves the pending one as it is
        return state
    seen = state.seen + 1 if label == state.pending else 1
    if seen >= confirm:
        return SwitchState(label, score)
    return SwitchState(state.stable, state.score, label, seen)


OTHER, AS_BEFORE = 0, 1  # a displayed label that a stretch does not hold; a pending one that it leaves as it is


class Switching:
    """A stretch of candidates as a table of where each state leads.

    Of the displayed label only matters whether it is one of the stretch's labels, and which; of the pending one only whether it
    is the first confident label of the stretch, and how often it was seen: any other is replaced by that one or
    dropped before it counts. So a body has one row for each of these (``confirm`` per label), whatever the
    number of labels elsewhere. A score that is null in a body is the score the stretch was entered with.
    """

    def __init__(self, min_score: float, confirm: int):
        self.rules = (min_score, max(1, confirm))

    def _entries(self, labels: list, first: list) -> list[tuple[list, SwitchState]]:
        out = []
        for stable in [OTHER, None, *labels]:
            counts = range(self.rules[1]) if first and stable is not None else range(1)
            out += [([stable, n], SwitchState(stable, None, first[0], n) if n else SwitchState(stable, None, AS_BEFORE, 0)) for n in counts]
        return out

    def sum_up(self, candidates: Sequence, scores: Sequence[float]) -> Body:
        labels = sorted({c for c in candidates if c is not None})
        first = next(([c] for c, s in zip(candidates, scores) if s >= self.rules[0]), [])
        entries = self._entries(labels, first)
        states = {state for _, state in entries}
        leads = {state: state for state in states}  # entry -> where it is now
        for label, score in zip(candidates, scores):
            moved = {state: switch(state, label, score, *self.rules) for state in states}
            if any(a is not b for a, b in moved.items()):
                leads = {entry: moved[state] for entry, state in leads.items()}
                states = set(moved.values())
        return {"labels": labels, "first": first, "leads": [[*key, *leads[state]] for key, state in entries]}

    def follow(self, body: Body, state: SwitchState, table: dict | None = None) -> SwitchState:
        table = table or self.table(body)
        known = state.stable is None or state.stable in body["labels"]
        n = state.seen if body["first"] and state.pending == body["first"][0] and state.stable is not None else 0
        stable, score, pending, seen = table[state.stable if known else OTHER, n]
        if pending == AS_BEFORE:
            pending, seen = state.pending, state.seen
        return SwitchState(state.stable if stable == OTHER else stable, state.score if score is None else score, pending, seen)

    def table(self, body: Body) -> dict:
        return {(stable, n): leave for stable, n, *leave in body["leads"]}

    def compose(self, a: Body, b: Body) -> Body:
        labels, first = sorted({*a["labels"], *b["labels"]}), a["first"] or b["first"]
        one, two = self.table(a), self.table(b)
        entries = self._entries(labels, first)
        return {"labels": labels, "first": first, "leads": [[*key, *self.follow(b, self.follow(a, state, one), two)] for key, state in entries]}


def class_label(labels: Sequence[str], index: int) -> str:
    return labels[index] if index < len(labels) else f"class_{index}"


class AverageFold(Fold):
    """Fading average of ``probs`` per key."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], alpha: float, probs: str = "probs", name: str = "ema"):
        self.keys, self.order, self.inputs = tuple(keys), tuple(order), (probs,)
        self.outputs = T.StructType([T.StructField(name, T.ArrayType(T.DoubleType()))])
        self.alpha, self.probs, self.name = alpha, probs, name

    def start(self) -> State:
        return {"ema": None}

    def run(self, state: State, rows: Columns, size: int) -> tuple[State, Columns]:
        out = fade(None if state["ema"] is None else np.array(state["ema"]), rows[self.probs], self.alpha)
        return {"ema": out[-1].tolist()}, {self.name: out}

    def heads(self, parts: Bucketed) -> DataFrame:
        return average_heads(parts, self, self.alpha, self.probs)

    def enter(self, state: State, head: Body) -> State:
        return {"ema": Fading(self.alpha).average(head["ema"])}


def average_heads(parts: Bucketed, fold: Fold, alpha: float, probs: str) -> DataFrame:
    fading = Fading(alpha)
    sum_up = lambda state, rows, size: (state, {"ema": fading.sum_up(rows[probs])})
    compose = lambda a, b: {"ema": fading.compose(a["ema"], b["ema"])}
    return before(bodies(parts, fold, sum_up, compose), parts.keys, compose)


class SwitchFold(Fold):
    """Displayed label per key from (candidate, score) rows."""

    def __init__(
        self,
        keys: Sequence[str],
        order: Sequence[str],
        min_score: float,
        confirm: int,
        candidate: str = "candidate",
        score: str = "candidate_score",
    ):
        self.keys, self.order, self.inputs = tuple(keys), tuple(order), (candidate, score)
        self.outputs = T.StructType(
            [T.StructField("stable_label", T.StringType()), T.StructField("stable_score", T.DoubleType())]
        )
        self.min_score, self.confirm = min_score, confirm
        self.candidate, self.score = candidate, score

    def start(self) -> State:
        return {"switch": list(SwitchState())}

    def run(self, state: State, rows: Columns, size: int) -> tuple[State, Columns]:
        current, shown = SwitchState(*state["switch"]), []
        for label, score in zip(rows[self.candidate], rows[self.score].tolist()):
            current = switch(current, label, score, self.min_score, self.confirm)
            shown.append(current)
        return {"switch": list(current)}, {
            "stable_label": [s.stable for s in shown],
            "stable_score": [s.score for s in shown],
        }

    def heads(self, parts: Bucketed) -> DataFrame:
        switching = Switching(self.min_score, self.confirm)
        candidate, score = self.candidate, self.score
        sum_up = lambda state, rows, size: (state, {"switch": switching.sum_up(rows[candidate].tolist(), rows[score].tolist())})
        compose = lambda a, b: {"switch": switching.compose(a["switch"], b["switch"])}
        return before(bodies(parts, self, sum_up, compose), parts.keys, compose)

    def enter(self, state: State, head: Body) -> State:
        return {"switch": list(Switching(self.min_score, self.confirm).follow(head["switch"], SwitchState()))}


class CandidateFold(Fold):
    """Fading average and vote of a track. ``model`` names what the probabilities come from; a new one starts afresh."""

    def __init__(
        self,
        keys: Sequence[str],
        order: Sequence[str],
        labels: Sequence[str],
        settings: LiveSettings = LiveSettings(),
        probs: str = "probs",
        model: str | None = None,
    ):
        self.keys, self.order, self.inputs = tuple(keys), tuple(order), (probs,)
        self.outputs = T.StructType(
            [T.StructField("vote_label", T.StringType()), T.StructField("ema_score", T.DoubleType())]
        )
        self.labels, self.settings, self.probs, self.model = list(labels), settings, probs, model

    def start(self) -> State:
        return {"ema": None, "votes": [], "model": self.model}

    def run(self, state: State, rows: Columns, size: int) -> tuple[State, Columns]:
        if state.get("model") != self.model:  # what another model gave is forgotten
            state = self.start()
        averages = fade(None if state["ema"] is None else np.array(state["ema"]), rows[self.probs], self.settings.ema_alpha)
        # A shorter window than the state was built with keeps the newest votes.
        window = deque(state["votes"], maxlen=self.settings.votes)
        votes = [vote(window, class_label(self.labels, top)) for top in averages.argmax(axis=1).tolist()]
        return {"ema": averages[-1].tolist(), "votes": list(window), "model": self.model}, {
            "vote_label": votes,
            "ema_score": averages.max(axis=1),
        }

    def heads(self, parts: Bucketed) -> DataFrame:
        """The averages first; with them known, the newest labels of each bucket."""
        known = stored(average_heads(parts, self, self.settings.ema_alpha, self.probs), "averages")
        size = self.settings.votes
        compose = lambda a, b: {"votes": (a["votes"] + b["votes"])[-size:]}

        def sum_up(state: State, rows: Columns, n: int) -> tuple[State, Body]:
            after, _ = CandidateFold.run(self, {**state, "votes": []}, rows, n)
            return after, {"votes": after["votes"]}

        return known.union(before(bodies(parts, self, sum_up, compose, known), parts.keys, compose))

    def enter(self, state: State, head: Body) -> State:
        if "ema" in head:
            return {**state, "ema": Fading(self.settings.ema_alpha).average(head["ema"])}
        return {**state, **head}


class SmoothFold(CandidateFold):
    """Average, vote and switch in one pass, as a live track does it."""

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self.outputs = T.StructType(
            [
                *self.outputs.fields,
                T.StructField("stable_label", T.StringType()),
                T.StructField("stable_score", T.DoubleType()),
            ]
        )

    def start(self) -> State:
        return {**super().start(), "switch": list(SwitchState())}

    def run(self, state: State, rows: Columns, size: int) -> tuple[State, Columns]:
        if state.get("model") != self.model:
            state = self.start()
        after, out = super().run(state, rows, size)
        current, shown = SwitchState(*state["switch"]), []
        for label, score in zip(out["vote_label"], out["ema_score"].tolist()):
            current = switch(current, label, score, self.settings.min_score, self.settings.confirm_frames)
            shown.append(current)
        shown_columns = {"stable_label": [s.stable for s in shown], "stable_score": [s.score for s in shown]}
        return {**after, "switch": list(current)}, {**out, **shown_columns}

    def heads(self, parts: Bucketed) -> DataFrame:
        """Averages and votes first; with them known, the switch."""
        known = stored(super().heads(parts), "votes")
        candidates = CandidateFold(self.keys, self.order, self.labels, self.settings, self.probs)
        switching = Switching(self.settings.min_score, self.settings.confirm_frames)
        compose = lambda a, b: {"switch": switching.compose(a["switch"], b["switch"])}

        def sum_up(state: State, rows: Columns, n: int) -> tuple[State, Body]:
            after, out = candidates.run(state, rows, n)
            return after, {"switch": switching.sum_up(out["vote_label"], out["ema_score"].tolist())}

        return known.union(before(bodies(parts, candidates, sum_up, compose, known), parts.keys, compose))

    def enter(self, state: State, head: Body) -> State:
        if "switch" in head:
            switching = Switching(self.settings.min_score, self.settings.confirm_frames)
            return {**state, "switch": list(switching.follow(head["switch"], SwitchState()))}
        return super().enter(state, head)


def average_probs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], alpha: float, span: float | None = None
) -> DataFrame:
    return fold_table(df, AverageFold(keys, order, alpha), span)


def vote_labels(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    label: str,
    size: int,
    span: float | None = None,
) -> DataFrame:
    """``vote_label``: the most frequent label of the last ``size`` rows, ties to the newest."""

    def winner(frame) -> Column:
        return _most_frequent(F.collect_list(label).over(frame))

    return trailing(df, keys, order, max(LiveSettings.LOWEST_VOTE_WINDOW, size), {"vote_label": winner}, span)


def _most_frequent(window: Column) -> Column:
    ranked = F.transform(
        F.array_distinct(F.reverse(window)),
        lambda label: F.struct(
            F.size(F.filter(window, lambda other: other == label)).alias("votes"),
            (-F.array_position(F.reverse(window), label)).alias("recent"),
            label.alias("label"),
        ),
    )
    return F.array_max(ranked)["label"]


def switch_labels(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    settings: LiveSettings = LiveSettings(),
    span: float | None = None,
) -> DataFrame:
    return fold_table(df, SwitchFold(keys, order, settings.min_score, settings.confirm_frames), span)


def smooth(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    labels: Sequence[str],
    settings: LiveSettings = LiveSettings(),
    span: float | None = None,
) -> DataFrame:
    return fold_table(df, SmoothFold(keys, order, labels, settings), span)
