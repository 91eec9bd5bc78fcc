import random

import pytest
from pyspark.sql import functions as F

import brute
from facetide.config import LiveSettings
from facetide.functions import boxes, probs, text, times
from facetide.functions.boxes import Box
from facetide.operators import detections as D

SCHEMA = "source_id string, frame_id long, det_no long, x int, y int, w int, h int"


def test_clamp_edges(spark):
    frame = spark.createDataFrame([("a", 1, 1, -10, 5, 50, 500, 100, 80), ("a", 1, 2, 100, 5, 50, 5, 100, 80)], SCHEMA + ", frame_w int, frame_h int")
    assert [tuple(r)[3:7] for r in D.clamped(frame).collect()] == [(0, 5, 50, 75)]
    assert [tuple(r)[3:7] for r in D.clamped(frame, width_from_raw=True).collect()] == [(0, 5, 40, 75)]


def test_box_rescale_and_relative(spark):
    row = spark.range(1).select(
        *[s.alias(f"r{i}") for i, s in enumerate(boxes.from_resized(Box(*[F.lit(v) for v in (10, 20, 33, 40)]), F.lit(1280)))],
        *[s.alias(f"s{i}") for i, s in enumerate(boxes.from_resized(Box(*[F.lit(v) for v in (10, 20, 33, 40)]), F.lit(320)))],
        *[s.alias(f"p{i}") for i, s in enumerate(boxes.relative_to_pixels(Box(*[F.lit(v) for v in (-0.011, 0.5, 0.25, 0.999)]), F.lit(100), F.lit(100)))],
        boxes.overlap(Box(*[F.lit(0)] * 4), Box(*[F.lit(0)] * 4)).alias("none"),
    ).first()
    assert tuple(row) == (20, 40, 66, 80, 10, 20, 33, 40, -1, 50, 25, 99, 0.0)


@pytest.mark.parametrize("span", [None, 2])
@pytest.mark.parametrize("shape", ["spread", "copies"])
def test_matches_before(spark, shape, span):
    rng = random.Random(shape)
    rows = []
    frames = [f for f in range(16) if f not in (3, 7, 8)]  # the frame before is the last that exists
    for frame in frames:
        for number in range(1, 15):
            box = (rng.randrange(-50, 600), rng.randrange(400), rng.randrange(1, 300), rng.randrange(1, 300))
            rows.append(("a", frame, number, *((10, 10, 50, 50) if shape == "copies" and number % 2 else box)))
    got = D.matches_before(spark.createDataFrame(rows, SCHEMA), 0.25, span).collect()
    want = {}
    for _, frame, number, *box in rows:
        scored = [(brute.iou(box, r[3:]), -r[2]) for r in rows if r[1] == max((f for f in frames if f < frame), default=None)]
        best = max(scored, default=(0, 0))
        if best[0] >= 0.25:
            want[frame, number] = (-best[1], best[0])
    assert {(r.frame_id, r.det_no): (r.prev_det_no, r.iou) for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        D.matches_before(spark.createDataFrame(rows, SCHEMA), 0.0)


def test_matches_before_has_no_cross_join(spark):
    frame = spark.createDataFrame([("a", 1, 1, 0, 0, 9, 9)], SCHEMA)
    plan = D.matches_before(frame)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("span", [None, 2.5])
def test_hold(spark, span):
    """Every third frame is searched, 100 ms apart, held for 150 ms: the second frame after is empty."""
    frames = spark.createDataFrame([("a", i, i * 0.1) for i in range(300)], "source_id string, frame_id long, ts double")
    found = spark.createDataFrame([("a", i, 1, i, 0, 5, 5) for i in range(300) if i % 6], SCHEMA)
    held = D.hold_boxes(frames, found, LiveSettings(hold_ms=150), span)
    got = {r.frame_id: (r.held_from, r.x) for r in held.collect()}
    searched = [i for i in range(0, 300, 3) if i % 6]  # every other search finds nothing, and holds nothing
    assert got == {f: (i, i) for i in searched for f in (i, i + 1)}
    assert D.hold_boxes(frames, found, LiveSettings(hold_ms=-5, detect_every_n=0)).count() == found.count()


def test_best_and_confident(spark):
    frame = spark.createDataFrame([("a", 1, 1, None), ("a", 1, 2, 0.5), ("a", 1, 3, 0.5), ("a", 2, 1, None), ("a", 3, 1, 0.4)],
                                  "source_id string, frame_id long, det_no long, conf double")
    assert [(r.frame_id, r.det_no) for r in D.best_detection(frame).orderBy("frame_id").collect()] == [(1, 2), (2, 1), (3, 1)]
    assert D.confident(frame).count() == 4
    assert D.confident(frame, default=0.0).count() == 2
    assert D.sampled_frames(frame, 2).count() == 1 and D.sampled_frames(frame, 0).count() == 5


def test_numbering(spark):
    frame = spark.createDataFrame([("a", 1, 5), ("a", 1, 3), ("b", 1, 9)], "source_id string, frame_id long, order_no long")
    rows = D.numbered_faces(frame, ["order_no"]).collect()
    assert {(r.source_id, r.order_no, r.face_id) for r in rows} == {("a", 3, 1), ("a", 5, 2), ("b", 9, 1)}


def test_probability_columns(spark):
    row = spark.range(1).select(
        probs.softmax(F.array(*[F.lit(x) for x in (1000.0, 1000.0, 0.0)])).alias("p"),
        probs.argmax(F.array(*[F.lit(x) for x in (0.1, 0.7, 0.7)])).alias("i"),
        probs.normalise_pixels(F.array(F.lit(0), F.lit(255))).alias("px"),
        probs.gray_to_channels(F.array(F.lit(1), F.lit(2))).alias("ch"),
    ).first()
    assert row.p == pytest.approx([0.5, 0.5, 0.0]) and row.i == 1 and row.px == [-1.0, 1.0] and row.ch == [1, 2] * 3


def test_text_and_time_columns(spark):
    lines = spark.range(1).select(text.label_lines(F.lit("﻿ anger \r\n\r\n fear\rjoy\n \n")).alias("l")).first().l
    assert lines == ["anger", "fear", "joy"]
    row = spark.range(1).select(
        text.kpi_text(F.lit(2.5)).alias("a"), text.kpi_text(F.lit(float("nan"))).alias("b"), text.kpi_text(F.lit(3.14), 1).alias("c"),
        times.drop_zone(F.lit("2024-01-01 10:00:00").cast("timestamp")).alias("d"),
    )
    assert tuple(row.first())[:3] == ("2", "—", "3.1") and dict(row.dtypes)["d"] == "timestamp_ntz"
