import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetide.operators.quantiles import percentiles
from facetide.plans import analytics
from facetide.sources.store import read_events, union_events

T0 = dt.datetime(2024, 5, 1, 12, 0, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("kind", ["spread", "two values", "one hot value", "tiny range"])
@pytest.mark.parametrize("small,listed", [(1_000_000, 50_000), (100, 40)])
def test_percentiles(spark, kind, small, listed):
    rng = random.Random(kind)
    data = {
        "spread": [rng.gauss(0, 1000) for _ in range(3000)],
        "two values": [float(i % 2) for i in range(3000)],
        "one hot value": [0.0 if i % 3 else rng.random() for i in range(3000)],
        "tiny range": [1.0 + rng.random() * 1e-12 for _ in range(2000)],
    }[kind]
    frame = spark.createDataFrame([(x, None) for x in data] + [(None, None)], "x double, y double")
    fractions = (0.0, 0.05, 0.5, 0.95, 1.0)
    rows, found = percentiles(frame, {"x": F.col("x"), "y": F.col("y")}, fractions, small, listed)
    assert rows == len(data) + 1
    assert found["x"] == pytest.approx(np.percentile(data, [f * 100 for f in fractions]), rel=1e-12, abs=1e-12)
    assert found["y"] == [None] * 5


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        ("a", at(0), "Happy", 0.9), ("b", at(30), "happy", 0.4), ("a", at(60), "sad", None),
        ("c", at(90), "sad", 0.95), ("a", None, "sad", 0.9), ("b", at(90), None, 0.7), ("b", at(31), "happy", float("nan")),
    ]
    return spark.createDataFrame(rows, "source_id string, event_ts timestamp, emotion string, score double")


def test_window_is_anchored_on_all_rows(events):
    kept = analytics.recent(events, 60)
    assert sorted(r.event_ts for r in kept.collect()) == [at(30), at(31), at(60), at(90), at(90)]
    # Camera a's own newest event would reach further back.
    assert analytics.filtered(events, 60, 0.0, "a").count() == 1
    assert analytics.recent(events, 59).count() == 4


def test_score_filter(events):
    assert analytics.min_score(events, 0.5).count() == 4
    assert analytics.min_score(events, 0.0).count() == 7
    texts = events.withColumn("score", F.col("score").cast("string"))
    assert analytics.min_score(texts, 0.5).count() == 4
    assert analytics.min_score(events.drop("score"), 0.5).count() == 7


def test_choice_of_time(spark, events):
    assert analytics.choose_time(events).name == "event_ts"
    emptied = events.withColumn("event_ts", F.lit(None).cast("timestamp"))
    assert analytics.choose_time(emptied) is None
    assert analytics.recent(emptied, 5).count() == 7
    text = emptied.withColumn("event_time", F.lit("2024-05-01 12:00:00"))
    chosen = analytics.choose_time(analytics.normalise(text))
    assert chosen.name == "event_time_dt" and chosen.newest == T0
    epoch = spark.createDataFrame([(1770943000100.0,), (1.0,)], "producer_ts double")
    assert analytics.choose_time(epoch).newest == dt.datetime(2026, 2, 13, 0, 36, 40)
    assert analytics.choose_time(spark.range(3)) is None


def test_wall_clock_window(events):
    now = F.lit(at(91))
    assert analytics.recent_by_clock(events, 5, F.col("event_ts"), now).count() == 2


def test_distribution_and_timeline(events):
    assert [tuple(r) for r in analytics.distribution(events).collect()] == [("happy", 3), ("sad", 3)]
    assert {r.emotion for r in analytics.distribution(events, legacy_case=True).collect()} == {"Happy", "happy", "sad"}
    double = events.unionAll(events.withColumn("emotion", F.upper("emotion")))
    merged = analytics.timeline(double, F.col("event_ts"))
    split = analytics.timeline(double, F.col("event_ts"), legacy_case=True)
    assert merged.count() == 5 and split.count() == 10
    wide = analytics.timeline_pivot(events, F.col("event_ts"), ["happy", "sad"]).collect()
    assert [(r.happy, r.sad) for r in wide] == [(1, 0), (1, 0), (1, 0), (0, 1), (0, 1)]


def test_latest_and_kpis(spark, events):
    assert [r.event_ts for r in analytics.latest(events, 3).collect()][:2] == [at(90), at(90)]
    assert analytics.latest(spark.range(10).withColumnRenamed("id", "frame_id"), 4).count() == 4
    row = analytics.kpis(events).first()
    assert row.events == 7 and row.latency_p50 is None and row.latency_p50_text == "—"
    timed = spark.createDataFrame([(2.0,), (3.0,)], "e2e_latency_ms double")
    assert analytics.kpis(timed).first().latency_p50_text == "2"  # 2.5, half to even
    assert analytics.kpis(timed, approximate=True).first().latency_p50 in (2.0, 3.0)


def test_store_reads_drifting_files_and_prunes(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([("a", at(0), "sad", dt.date(2024, 5, 1))], "source_id string, event_ts timestamp, emotion string, event_date date")
    second = spark.createDataFrame([("b", at(1440), "sad", 0.5, dt.date(2024, 5, 2))], "source_id string, event_ts timestamp, emotion string, score double, event_date date")
    first.write.partitionBy("event_date").parquet(path)
    second.write.mode("append").partitionBy("event_date").parquet(path)
    stored = read_events(spark, path)
    assert dict(stored.dtypes)["event_date"] == "date" and "score" in stored.columns and stored.count() == 2
    recent = analytics.recent(stored, 60, date_column="event_date")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(event_ts" in plan
    assert [r.source_id for r in recent.collect()] == ["b"]


def test_missing_store_is_empty(spark, tmp_path):
    (tmp_path / "void").mkdir()
    for path in (None, str(tmp_path / "nowhere"), str(tmp_path / "void")):
        assert read_events(spark, path).isEmpty() and "event_ts" in read_events(spark, path).columns
    (tmp_path / "void" / "broken.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception, match="broken"):
        read_events(spark, str(tmp_path / "void")).collect()


def test_union_by_name_widens_to_text(spark):
    one = spark.createDataFrame([("a", "2024-05-01 12:00:00")], "source_id string, event_time string")
    two = spark.createDataFrame([("b", T0, 1)], "source_id string, event_time timestamp, face_id int")
    rows = union_events(one, two).orderBy("source_id").collect()
    assert [tuple(r) for r in rows] == [("a", "2024-05-01 12:00:00", None), ("b", "2024-05-01 12:00:00", 1)]


def test_latest_takes_the_top_without_a_full_sort(events):
    plan = analytics.latest(events, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_recent_window_is_free_of_the_drivers_time_zone(spark, monkeypatch):
    """Python datetimes of a driver far from UTC never decide what is kept."""
    import time

    rows = [(T0 - dt.timedelta(hours=h), (T0 - dt.timedelta(hours=h)).date()) for h in range(9)]
    events = spark.createDataFrame(rows, "t timestamp_ntz, event_date date").selectExpr("CAST(t AS timestamp) AS event_ts", "event_date")
    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        base = analytics.choose_time(events, "event_date")
        assert base.newest == T0
        assert analytics.recent(events, 8 * 60, base, "event_date").count() == 9
    finally:
        monkeypatch.undo()
        time.tzset()


def test_mixed_depth_and_drifting_store(spark, tmp_path):
    path = str(tmp_path / "mixed")
    spark.sql("SELECT 1 AS frame_id, 'a' AS source_id").write.parquet(path)
    spark.sql("SELECT 2L AS frame_id, 'b' AS source_id, 0.5D AS score").write.mode("append").parquet(path)
    spark.sql("SELECT 3L AS frame_id, 'c' AS source_id, DATE'2026-02-13' AS event_date").write.mode("append").partitionBy("event_date").parquet(path)
    found = read_events(spark, path).select("frame_id", "source_id", "event_date").collect()
    assert sorted((r.frame_id, r.source_id, r.event_date) for r in found) == [(1, "a", None), (2, "b", None), (3, "c", dt.date(2026, 2, 13))]


def test_union_widens_numbers_and_pivot_takes_all_labels(spark):
    both = union_events(spark.sql("SELECT 1 AS n, 1.5F AS v, 'x' AS k"), spark.sql("SELECT 2L AS n, 2.5D AS v, 3 AS k"))
    assert dict(both.dtypes) == {"n": "bigint", "v": "double", "k": "string"}
    events = spark.createDataFrame([(T0, f"label{i % 7}") for i in range(70)], "event_ts timestamp, emotion string")
    row = analytics.timeline_pivot(events, F.col("event_ts")).first().asDict()
    assert sum(v for k, v in row.items() if k != "minute") == 70 and len(row) == 8


def test_percentiles_of_infinite_values(spark):
    frame = spark.createDataFrame([(x,) for x in [float("-inf")] * 20 + [1.0] * 60 + [float("inf")] * 20], "x double")
    for small in (0, 1000):
        assert percentiles(frame, {"x": F.col("x")}, (0.1, 0.5, 0.95), small)[1]["x"] == [float("-inf"), 1.0, float("inf")]


def test_a_face_is_scored_once(spark):
    from facetide.operators import scoring
    from facetide.sources import labels as label_source

    faces = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "face_id int, features array<double>")
    scored = scoring.usable(scoring.score_faces(faces, lambda: lambda x: x))
    named = scoring.with_labels(scored, label_source.label_values(spark, ["calm", "glad"]))
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython ") == 1 and "hashpartitioning(idx" not in plan
    assert sorted((r.face_id, r.label) for r in named.collect()) == [(1, "glad"), (2, "calm")]
