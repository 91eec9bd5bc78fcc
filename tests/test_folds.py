"""Folds on keys of one and of many buckets, against the plain sequential rules."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from facetide.config import LiveSettings
from facetide.operators import folds
from facetide.operators.folds import BODY, before, fold_table
from facetide.operators.ordered import BUCKET
from facetide.operators.smoothing import Switching, SwitchState, average_probs, smooth, switch, switch_labels, vote_labels
from facetide.operators.throttle import ThrottleFold, throttle
from facetide.operators.tracking import assign_tracks

SPANS = [None, 120, 37]


def times(kind, size=2500):
    rng = random.Random(kind)
    if kind == "periodic":  # chains entered at different rows never meet
        return [i / 30 for i in range(size)]
    if kind == "bursts":
        now, out = 0.0, []
        for _ in range(size):
            now += rng.choice([0.0, 0.01, 0.02, 0.3, 2.0]) if rng.random() < 0.3 else 0.01
            out.append(round(now, 3))
        return out
    if kind == "dense":  # whole chunks inside one interval
        return sorted(rng.random() * 3 for _ in range(size))
    return [5.0] * (size // 2) + [5.0 + i * 0.2 for i in range(size // 2)]  # half the rows at one time


@pytest.mark.parametrize("kind", ["periodic", "bursts", "dense", "equal"])
@pytest.mark.parametrize("span", [None, 4.0, 0.7, 0.05])
def test_throttle(spark, kind, span):
    series = times(kind)
    rows = [("cam", t, i, 0) for i, t in enumerate(series)] + [(f"c{i % 7}", float(i), i, 1) for i in range(300)]
    rows += [("cam", None, -1, 0), ("cam", float("nan"), -2, 0)]
    frame = spark.createDataFrame(rows, "source_id string, t double, frame_id long, face_id long").repartition(4)
    sent = throttle(frame, "t", 0.5, span=span)
    got = sorted(r.frame_id for r in sent.where("source_id = 'cam'").collect())
    assert got == [i for i, ok in enumerate(brute.throttle(series, 0.5)) if ok]
    assert sent.where("source_id <> 'cam'").count() == 300


def test_throttle_without_interval_and_per_face(spark):
    frame = spark.createDataFrame([("a", 1.0, 1, 1), ("a", 1.0, 1, 2), ("a", 1.2, 2, 1)], "source_id string, t double, frame_id long, face_id long")
    assert throttle(frame, "t", 0.0).count() == 3
    assert throttle(frame, "t", 0.5).count() == 1
    assert throttle(frame, "t", 0.5, keys=("source_id", "face_id"), ties=("frame_id",)).count() == 2


def vectors(seed, size, sharp):
    rng = random.Random(seed)
    out = []
    for _ in range(size):
        raw = [rng.random() ** sharp for _ in range(4)]
        out.append([x / sum(raw) for x in raw])
    return out


def faces(spark, hot):
    rows = [("cam", 1, i, p) for i, p in enumerate(hot)]
    rows += [("cam", 2 + i % 9, i, p) for i, p in enumerate(vectors(9, 200, 3))]
    return spark.createDataFrame(rows, "source_id string, track_id long, frame_id long, probs array<double>").repartition(4)


TRACK = ["source_id", "track_id"]


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("alpha", [0.65, 0.05])
def test_average(spark, span, alpha):
    hot = vectors(1, 1500, 3)
    done = average_probs(faces(spark, hot), TRACK, ["frame_id"], alpha, span)
    got = [r.ema for r in done.where("track_id = 1").orderBy("frame_id").collect()]
    for mine, want in zip(got, brute.averages(hot, alpha), strict=True):
        assert mine == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("span", SPANS)
def test_vote(spark, span):
    rng = random.Random(4)
    labels = [rng.choice("abcd") for _ in range(1500)]
    frame = spark.createDataFrame([("x", i, v) for i, v in enumerate(labels)], "k string, n long, label string")
    got = [r.vote_label for r in vote_labels(frame, ["k"], ["n"], "label", 15, span).orderBy("n").collect()]
    assert got == brute.votes(labels, 15)


@pytest.mark.parametrize("low", [0.0, 0.5, 1.01])
@pytest.mark.parametrize("span", SPANS)
def test_switch(spark, span, low):
    """With ``low`` above every score nothing ever switches, so no chunk forgets its start."""
    rng = random.Random(5)
    offers = [(rng.choice("aabc"), rng.random()) for _ in range(1500)]
    rows = [("x", i, label, score) for i, (label, score) in enumerate(offers)]
    frame = spark.createDataFrame(rows, "k string, n long, candidate string, candidate_score double")
    settings = LiveSettings(min_score=low, confirm_frames=3)
    shown = switch_labels(frame, ["k"], ["n"], settings, span).orderBy("n").collect()
    assert [(r.stable_label, r.stable_score) for r in shown] == brute.switch(offers, low, 3)


def test_switch_with_missing_labels_and_many_of_them(spark):
    rng = random.Random(6)
    names = [f"n{i}" for i in range(300)]
    offers = [(rng.choice([None, None, "a", rng.choice(names)]), rng.random()) for _ in range(900)]
    rows = [("x", i, label, score) for i, (label, score) in enumerate(offers)]
    frame = spark.createDataFrame(rows, "k string, n long, candidate string, candidate_score double")
    settings = LiveSettings(min_score=0.2, confirm_frames=2)
    shown = [switch_labels(frame, ["k"], ["n"], settings, span).orderBy("n").collect() for span in (None, 50, 7)]
    assert shown[0] == shown[1] == shown[2]
    state, want = SwitchState(), []
    for label, score in offers:
        state = switch(state, label, score, 0.2, 2)
        want.append((state.stable, state.score))
    assert [(r.stable_label, r.stable_score) for r in shown[0]] == want


def test_switching_tables_compose():
    rng = random.Random(2)
    for confirm in (1, 2, 4):
        rule = Switching(0.4, confirm)
        for _ in range(60):
            parts = [[(rng.choice([None, "a", "b", "c"]), rng.random()) for _ in range(rng.randint(1, 5))] for _ in range(4)]
            bodies = [rule.sum_up(*zip(*part)) for part in parts]
            left = rule.compose(rule.compose(bodies[0], bodies[1]), rule.compose(bodies[2], bodies[3]))
            right = rule.compose(bodies[0], rule.compose(bodies[1], rule.compose(bodies[2], bodies[3])))
            for label in (None, "a", "b", "z"):
                for pending in (None, "a", "c", "y"):
                    for seen in range(confirm):
                        if label is None and (pending or seen) or pending is not None and not seen or pending == label:
                            continue
                        begun = state = SwitchState(label, 0.5, pending, seen)
                        for offer in (o for part in parts for o in part):
                            state = switch(state, *offer, 0.4, confirm)
                        assert rule.follow(left, begun) == rule.follow(right, begun) == state


def test_before_composes_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(folds, "FAN", 3)
    rows = [("a", i, f'"{i} "') for i in range(100) if i % 7] + [("b", 5, '"x"'), (None, 1, '"y"'), (None, 2, '"z"')]
    table = spark.createDataFrame(rows, f"k string, {BUCKET} long, {BODY} string").repartition(4)
    got = {(r[0], r[1]): r[2] for r in before(table, ["k"], lambda a, b: a + b).collect()}
    numbers = [i for i in range(100) if i % 7]
    want = {("a", n): '"' + "".join(f"{m} " for m in numbers if m < n) + '"' for n in numbers[1:]}
    assert got == {**want, (None, 2): '"y"'}


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("sharp", [1, 6])
def test_smooth(spark, span, sharp):
    hot = vectors(7, 1200, sharp)
    settings = LiveSettings(min_score=0.5, confirm_frames=3, vote_window=5)
    names = ["a", "b", "c"]  # class 3 has no name
    shown = smooth(faces(spark, hot), TRACK, ["frame_id"], names, settings, span)
    got = shown.where("track_id = 1").orderBy("frame_id").collect()
    means = brute.averages(hot, settings.ema_alpha)
    top = [(m.index(max(m)), max(m)) for m in means]
    votes = brute.votes([names[i] if i < 3 else f"class_{i}" for i, _ in top], 5)
    want = brute.switch([(v, s) for v, (_, s) in zip(votes, top)], 0.5, 3)
    assert [r.vote_label for r in got] == votes
    assert [r.stable_label for r in got] == [label for label, _ in want]
    assert [r.stable_score for r in got] == pytest.approx([score for _, score in want], abs=1e-9)


def walk(seed, size, people, grid=1):
    """Frames of boxes that wander, vanish and come back."""
    rng = random.Random(seed)
    spots = [[rng.randrange(300), rng.randrange(200)] for _ in range(people)]
    frames, now = [], 0.0
    for i in range(size):
        now += 5.0 if rng.random() < 0.002 else 0.1
        boxes = []
        for spot in spots:
            spot[0] += rng.choice([-4, 0, 4]) * grid
            spot[1] += rng.choice([-4, 0, 4]) * grid
            if rng.random() < 0.8:
                boxes.append((spot[0], spot[1], 40, 40))
        rng.shuffle(boxes)
        frames.append((now, boxes))
    return frames


def tie_frames():
    """Two still faces; now and then a box exactly between them decides by age alone."""
    frames = []
    for i in range(900):
        a, b, middle = (0, 0, 40, 40), (40, 0, 40, 40), (20, 0, 40, 40)
        boxes = [middle] if i % 97 == 50 else ([b, a] if i else [a, b])
        frames.append((i * 0.1, boxes))
    return frames


@pytest.mark.parametrize("span", [None, 21.0, 5.0])
@pytest.mark.parametrize("case", ["wander", "crowd", "still", "ties"])
def test_tracks(spark, span, case):
    frames = {
        "wander": lambda: walk(1, 700, 3),
        "crowd": lambda: walk(2, 150, 12),
        "still": lambda: walk(3, 600, 3, grid=0),
        "ties": tie_frames,
    }[case]()
    rows = [("cam", now, i, n, *box) for i, (now, boxes) in enumerate(frames) for n, box in enumerate(boxes)]
    rows += [("other", float(i), i, 0, 0, 0, 9, 9) for i in range(40)]
    frame = spark.createDataFrame(rows, "source_id string, ts double, frame_id long, det_no long, x int, y int, w int, h int")
    settings = LiveSettings(match_overlap=0.25)
    done = assign_tracks(frame.repartition(4), settings=settings, span=span)
    got = {(r.frame_id, r.det_no): r.track_id for r in done.where("source_id = 'cam'").collect()}
    want = brute.tracks(frames, 0.9, 0.25)
    assert got == {(i, n): t for i, numbers in enumerate(want) for n, t in enumerate(numbers)}
    assert done.count() == len(rows)


def test_rows_of_a_long_key_are_spread(spark, monkeypatch):
    """With joins by shuffle, the rows of one camera must not meet in one task."""
    rows = spark.range(4000).select(F.when(F.col("id") < 3990, "cam").alias("k"), (F.col("id") * 10.0).alias("t"), F.col("id").alias("n"))
    seen = []
    fold = ThrottleFold(("k",), "t", ("n",), 25.0)
    heads = fold.heads
    monkeypatch.setattr(fold, "heads", lambda parts: (seen.append(parts.rows.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]), heads(parts))[1])
    kept = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        marked = fold_table(rows, fold, 100.0)
        assert marked.where("passed").groupBy("k").count().orderBy("k").toPandas()["count"].tolist() == [4, 1330]
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert seen[0].sum() == 3990 and seen[0].max() < 2000
