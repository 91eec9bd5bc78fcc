import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from facetide.config import IngestSettings, LiveSettings
from facetide.plans import ingest

ARRIVED = dt.datetime(2026, 2, 13, 0, 36, 42)
GOOD = {
    "source_id": "cam_01", "frame_id": 901, "face_id": 1, "producer_ts": 1770943000.1, "emotion": "happy",
    "score": 0.91, "bbox_x": 10, "bbox_y": 20, "bbox_w": 100, "bbox_h": 120,
}
PRODUCED = dt.datetime(2026, 2, 13, 0, 36, 40)


def run(spark, *messages, **options):
    rows = [(bytearray(m if isinstance(m, bytes) else m.encode()), ARRIVED) for m in messages]
    raw = spark.createDataFrame(rows, "value binary, timestamp timestamp")
    return ingest.ingest(raw, arrival="timestamp", **options).collect()


def with_(**changes):
    return json.dumps({**GOOD, **changes})


def test_good_message(spark):
    row = run(spark, json.dumps(GOOD))[0]
    assert row.event_ts == row.event_time == PRODUCED
    assert row.event_minute == dt.datetime(2026, 2, 13, 0, 36) and row.event_date == dt.date(2026, 2, 13)
    assert row.e2e_latency_ms == pytest.approx(1900.0, abs=1e-3) and row.processing_time_ms is None
    assert row.spark_ts == ARRIVED and row.producer_ts_sec == 1770943000.1


def test_milliseconds_are_divided(spark):
    row = run(spark, with_(producer_ts=1770943000100))[0]
    assert row.event_ts == PRODUCED and row.producer_ts_sec == pytest.approx(1770943000.1)


@pytest.mark.parametrize("body", [{"producer_ts": None}, {"producer_ts": "1770943000.1"}])
def test_missing_producer_time(spark, body):
    row = run(spark, with_(**body))[0]
    assert row.producer_ts is None and row.event_ts == ARRIVED and row.e2e_latency_ms == 0.0


@pytest.mark.parametrize("value", ["NaN", "1e12", "1e300", "-1e300", "Infinity", "1e18"])
def test_strange_producer_time_does_not_stop(spark, value):
    row = run(spark, json.dumps(GOOD).replace("1770943000.1", value))[0]
    assert row.event_ts == ARRIVED


def test_partial_values(spark):
    assert run(spark, with_(bbox_x=1.5))[0].bbox_x is None
    assert run(spark, with_(source_id=5))[0].source_id == "5"
    assert len(run(spark, '{"source_id":5,"emotion":"a"}')) == 1


@pytest.mark.parametrize("message", ['{"hello":"world"}', "hello from jupyter", "", "[1]", '{"source_id":"a"}'])
def test_foreign_messages_are_dropped(spark, message):
    assert run(spark, message) == []


def test_weaker_requirement_and_unclamped(spark):
    assert len(run(spark, '{"source_id":"a"}', required=["source_id"])) == 1
    late = run(spark, with_(producer_ts=1770943010.0), clamp=False)[0]
    assert late.e2e_latency_ms == pytest.approx(-8000.0)
    assert run(spark, with_(producer_ts=None), clamp=False)[0].e2e_latency_ms is None


def test_producer_time_mark(spark):
    events = spark.createDataFrame([(None,), (5.0,), (math.nan,)], "producer_ts double")
    for name, kind in {"source_id": "string", "frame_id": "long", "face_id": "long", "emotion": "string", "score": "double",
                       "bbox_x": "int", "bbox_y": "int", "bbox_w": "int", "bbox_h": "int"}.items():
        events = events.withColumn(name, F.lit(None).cast(kind))
    marked = ingest.enrich(events, F.lit(ARRIVED), mark_producer_ts=True)
    assert sorted(r.has_producer_ts for r in marked.collect()) == [False, False, True]


def test_legacy_raw(spark):
    raw = spark.createDataFrame([(bytearray(b"hi"),)], "value binary")
    assert ingest.raw_messages(raw, F.lit(ARRIVED)).first().asDict() == {"message": "hi", "event_time": ARRIVED}


def test_unknown_settings_raise():
    with pytest.raises(ValueError):
        IngestSettings.of({"STARTING_OFFSETS": "earliest"})
    assert IngestSettings.of({"trigger": "1 second"}).trigger == "1 second"
    assert LiveSettings.of({"vote_window": 1}).votes == 3
    assert LiveSettings(track_ttl_ms=50).ttl_seconds == 0.2
