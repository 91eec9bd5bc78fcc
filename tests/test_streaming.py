import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from facetide.config import IngestSettings, LiveSettings
from facetide.operators import tracking
from facetide.operators.detections import HoldFold
from facetide.operators.smoothing import SmoothFold, smooth
from facetide.operators.throttle import ThrottleFold
from facetide.operators.tracking import TrackFold, assign_tracks
from facetide.plans import analytics, ingest, live, queries, views
from facetide.schemas import EVENT_STORED
from facetide.sinks import files, kafka as kafka_sink
from facetide.sources import kafka as kafka_source
from facetide.sources.store import stream_events
from facetide.streaming import jobs
from facetide.streaming.stateful import Forget, fold_stream, late_rows, timely


@pytest.fixture(scope="module")
def raw(spark, folder):
    return views.messages(views.table(spark, folder, "events")).persist()


def feed(rows, path, parts):
    """Append ``rows`` to ``path`` as files; list of row filters gives the files' contents."""
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(path)


def run(stream, path, mark, **options):
    files.append_stream(stream, path, mark, "available-now", **options).awaitTermination()


def test_ingest_stream_survives_restart_without_duplicates(spark, raw, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    feed(raw, source, ["crc32(value) % 3 = 0", "crc32(value) % 3 = 1"])
    stream = ingest.ingest(stream_events(spark, source, raw.schema, max_files=1), arrival="timestamp")
    run(stream, out, mark)
    run(stream, out, mark)  # nothing new
    feed(raw, source, ["crc32(value) % 3 = 2"])
    run(stream, out, mark)
    stored = spark.read.parquet(out)
    batch = ingest.ingest(raw, arrival="timestamp")
    same = [f.name for f in EVENT_STORED]
    assert stored.select(same).exceptAll(batch.select(same)).isEmpty()
    assert stored.count() == batch.count() == raw.count()
    assert dict(stored.dtypes)["event_date"] == "date"
    plan = stored.where("event_date = date'2024-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_default_arrival_is_the_batch_time(spark, raw, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    feed(raw, source, ["true"])
    run(ingest.ingest(stream_events(spark, source, raw.schema)), out, mark, partition_by=None)
    assert spark.read.parquet(out).select("spark_ts").distinct().count() == 1


def test_two_sinks(spark, raw, tmp_path):
    source = str(tmp_path / "in")
    feed(raw, source, ["true"])
    stream = ingest.raw_messages(stream_events(spark, source, raw.schema), F.col("timestamp"))
    targets = [(str(tmp_path / f"out{i}"), str(tmp_path / f"mark{i}")) for i in range(2)]
    for started in files.append_to_both(stream, *targets, "available-now"):
        started.awaitTermination()
    assert [spark.read.parquet(path).count() for path, _ in targets] == [raw.count()] * 2


def test_console_and_waiting(spark, raw, tmp_path):
    source = str(tmp_path / "in")
    feed(raw.limit(2), source, ["true"])
    stream = stream_events(spark, source, raw.schema).select(F.col("value").cast("string"))
    spark.streams.resetTerminated()
    started = files.print_stream(stream, str(tmp_path / "mark"), "available-now")
    jobs.wait_for_any(spark)
    assert not started.isActive


def test_live_timeline_over_several_batches(spark, raw, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    feed(raw, source, [f"crc32(value) % 4 = {i}" for i in range(4)])
    events = ingest.ingest(stream_events(spark, source, raw.schema, max_files=1), arrival="timestamp")
    jobs.keep_updates(jobs.live_timeline(events, "100 days"), out, mark, "available-now").awaitTermination()
    now = jobs.current_rows(spark, out, ["minute", "emotion"])
    batch = analytics.timeline(ingest.ingest(raw, arrival="timestamp"), F.col("event_ts"))
    assert now.exceptAll(batch).isEmpty() and now.count() == batch.count()
    assert len(list((tmp_path / "out").glob("_batch=*"))) >= 4


def events(size=400, seed=1):
    rng = random.Random(seed)
    now, rows = 0.0, []
    for i in range(size):
        now += rng.choice([0.0, 0.1, 0.2, 3.0])
        rows.append((f"cam{i % 2}", round(now, 2), i, 0))
    return rows


@pytest.mark.parametrize("cut", [[400], [1, 150, 151, 400], list(range(50, 401, 50))])
def test_throttle_stream_does_not_depend_on_batches(spark, tmp_path, cut):
    rows = events()
    frame = spark.createDataFrame(rows, "source_id string, t double, frame_id long, face_id long")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    fold = ThrottleFold(("source_id",), "t", ("frame_id", "face_id"), 0.5)
    for low, high in zip([0, *cut], cut):  # one restart per part
        feed(frame, source, [f"frame_id >= {low} AND frame_id < {high}"])
        stream = fold_stream(stream_events(spark, source, frame.schema), fold)
        run(stream, out, mark, partition_by=None)
    done = spark.read.parquet(out)
    assert done.where("late").count() == 0 and done.count() == len(rows)
    for camera in ("cam0", "cam1"):
        mine = [r for r in rows if r[0] == camera]
        want = [r[2] for r, ok in zip(mine, brute.throttle([r[1] for r in mine], 0.5)) if ok]
        assert sorted(r.frame_id for r in done.where(F.col("source_id") == camera).where("passed").collect()) == want


def test_late_rows_are_marked_and_do_not_rewind(spark, tmp_path):
    frame = spark.createDataFrame([("a", 10.0, 1, 0), ("a", 2.0, 2, 0), ("a", 10.6, 3, 0)], "source_id string, t double, frame_id long, face_id long")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    fold = ThrottleFold(("source_id",), "t", ("frame_id", "face_id"), 0.5)
    for i in (1, 2, 3):
        feed(frame, source, [f"frame_id = {i}"])
        run(fold_stream(stream_events(spark, source, frame.schema), fold), out, mark, partition_by=None)
    got = {r.frame_id: (r.passed, r.late) for r in spark.read.parquet(out).collect()}
    assert got == {1: (True, False), 2: (None, True), 3: (True, False)}


def test_smoothing_and_vote_length_change(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        raw = [rng.random() ** 3 for _ in range(3)]
        rows.append(("a", 1 + i % 2, i, [x / sum(raw) for x in raw]))
    frame = spark.createDataFrame(rows, "source_id string, track_id long, frame_id long, probs array<double>")
    settings = LiveSettings(min_score=0.4, confirm_frames=2, vote_window=7)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    keys = ("source_id", "track_id")
    for low in (0, 100, 200):
        feed(frame, source, [f"frame_id >= {low} AND frame_id < {low + 100}"])
        stream = timely(fold_stream(stream_events(spark, source, frame.schema), SmoothFold(keys, ("frame_id",), "xyz", settings)))
        run(stream, out, mark, partition_by=None)
    rounded = {name: F.round(name, 9) for name in ("ema_score", "stable_score")}  # averages of rows cut otherwise differ in the last bit
    streamed, batch = (rows.withColumns(rounded) for rows in (spark.read.parquet(out), smooth(frame, keys, ["frame_id"], "xyz", settings)))
    assert streamed.select(batch.columns).exceptAll(batch).isEmpty() and streamed.count() == 300
    fold = SmoothFold(keys, ("frame_id",), "xyz", LiveSettings(vote_window=3))
    import numpy as np

    state, _ = fold.run({**fold.start(), "votes": list("xxxyyzz")}, {"probs": np.array([[0.0, 0.0, 1.0]])}, 1)
    assert state["votes"] == ["z", "z", "z"]


def test_tracks_and_holds_equal_their_tables(spark, tmp_path):
    rng = random.Random(8)
    rows = [("a", i * 0.1, i, n, 50 * n + rng.randrange(9), rng.randrange(9), 40, 40) for i in range(150) for n in range(3)]
    frame = spark.createDataFrame(rows, "source_id string, ts double, frame_id long, det_no long, x int, y int, w int, h int")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for low in (0, 50, 100):
        feed(frame, source, [f"frame_id >= {low} AND frame_id < {low + 50}"])
        run(timely(fold_stream(stream_events(spark, source, frame.schema), TrackFold())), out, mark, partition_by=None)
    streamed, batch = spark.read.parquet(out), assign_tracks(frame)
    assert streamed.select(batch.columns).exceptAll(batch).isEmpty() and streamed.count() == len(rows)
    pictures = spark.createDataFrame([("a", i, i * 0.1, json.dumps([i]) if i % 2 else None) for i in range(9)],
                                     "source_id string, frame_id long, ts double, boxes string")
    source, out, mark = (str(tmp_path / f"{n}2") for n in ("in", "out", "mark"))
    for i in range(9):
        feed(pictures, source, [f"frame_id = {i}"])
        run(timely(fold_stream(stream_events(spark, source, pictures.schema), HoldFold(LiveSettings(hold_ms=150)))), out, mark, partition_by=None)
    got = [(r.shown, r.held_from) for r in spark.read.parquet(out).orderBy("frame_id").collect()]
    assert got == [("[]", 0), ("[]", 0), ("[]", None), ("[3]", 3), ("[3]", 3), ("[]", None), ("[]", 6), ("[]", 6), ("[]", None)]


def test_forgetting_ended_tracks(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"t{i // 10}", start + dt.timedelta(seconds=i * 60), float(i), i, 0) for i in range(40)]
    frame = spark.createDataFrame(rows, "source_id string, at timestamp, t double, frame_id long, face_id long")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    feed(frame, source, [f"frame_id >= {i} AND frame_id < {i + 10}" for i in range(0, 40, 10)])
    fold = ThrottleFold(("source_id",), "t", ("frame_id", "face_id"), 0.5)
    stream = stream_events(spark, source, frame.schema, max_files=1).withWatermark("at", "1 minute")
    query = files.append_stream(fold_stream(stream, fold, Forget("at", 1000)), out, mark, "available-now", partition_by=None)
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert kept[-1] == 1 and spark.read.parquet(out).where("passed").count() == 40


def test_frames_to_events_feeds_ingest(spark):
    frames = spark.createDataFrame([("a", i, i * 0.1) for i in range(1, 60)], "source_id string, frame_id long, ts double")
    found = spark.createDataFrame(
        [("a", i, 1, 5, 5, 40, 40, 0.9, 100, 100, [0.0, 4.0]) for i in range(1, 60)],
        "source_id string, frame_id long, det_no long, x int, y int, w int, h int, conf double, frame_w int, frame_h int, features array<double>",
    )
    sent = live.frames_to_events(frames, found, lambda: lambda features: features, labels=["calm", "joy"]).persist()
    rows = sent.orderBy("frame_id").collect()
    shown = range(3, 60)  # the first searched frame is the third
    assert [r.frame_id for r in rows] == [i for i, ok in zip(shown, brute.throttle([i * 0.1 for i in shown], 0.5)) if ok]
    assert {r.emotion for r in rows} == {"joy"} and {r.face_id for r in rows} == {1}
    stored = ingest.ingest(kafka_sink.to_messages(sent))
    assert stored.count() == len(rows) and stored.where("score > 0.9").count() == len(rows)


def test_kafka_options_and_messages(spark):
    options = kafka_source.stream_options("h:9092", "t", max_offsets_per_trigger=2000)
    assert options == {"kafka.bootstrap.servers": "h:9092", "subscribe": "t", "startingOffsets": "latest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": "2000"}
    with pytest.raises(ValueError):
        kafka_source.stream_options("h", "t", starting_offsets="soon")
    assert kafka_source.bounded_options("h", "t")["startingOffsets"] == "earliest"
    sink = kafka_sink.options("h", "t")
    assert sink["kafka.acks"] == "1" and sink["kafka.linger.ms"] == "10"
    frame = spark.createDataFrame([("кам", 1, "радость")], "source_id string, frame_id long, emotion string")
    row = kafka_sink.to_messages(frame, key="k").first()
    assert row.key == "k" and json.loads(row.value) == {"source_id": "кам", "frame_id": 1, "emotion": "радость"} and "кам" in row.value
    assert kafka_sink.to_messages(frame, key=F.col("source_id")).first().key == "кам"
    assert IngestSettings().max_offsets_per_trigger is None


def test_label_files_and_compaction(spark, tmp_path):
    labels = spark.createDataFrame([(1, "joy"), (0, "anger"), (2, "скука")], "idx int, label string").repartition(3)
    files.write_labels(labels, str(tmp_path / "json"), str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["anger", "joy", "скука"]
    written = [json.loads(r.value)["label"] for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert written == ["anger", "joy", "скука"]
    many = spark.range(0, 3000, 1, 30).select("id", F.when(F.col("id") % 3 == 0, F.lit("2024-01-02")).otherwise("2024-01-01").cast("date").alias("event_date"))
    files.compact_dates(many, str(tmp_path / "compact"), rows_per_file=1500)
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 3000
    assert 2 <= len(list((tmp_path / "compact").rglob("*.parquet"))) <= 6


def test_late_rows_are_kept_beside_the_others(spark, tmp_path):
    frame = spark.createDataFrame([("a", 10.0, 1, 0), ("a", 2.0, 2, 0), ("a", 10.6, 3, 0)], "source_id string, t double, frame_id long, face_id long")
    source = str(tmp_path / "in")
    feed(frame, source, [f"frame_id = {i}" for i in (1, 2, 3)])
    fold = ThrottleFold(("source_id",), "t", ("frame_id", "face_id"), 0.5)
    done = jobs.run_to_end(fold_stream(stream_events(spark, source, frame.schema, max_files=1), fold), "late-test", "late")
    assert [r.frame_id for r in late_rows(done).collect()] == [2]
    assert sorted(r.frame_id for r in timely(done).collect()) == [1, 3]


def test_accounts_of_a_watermark(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=m), "joy") for i, m in enumerate([0, 60, 1, 61, 2, 62])]
    frame = spark.createDataFrame(rows, "n long, event_ts timestamp, emotion string")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    feed(frame, source, [f"n >= {i} AND n < {i + 2}" for i in (0, 2, 4)])
    stream = jobs.counted_input(stream_events(spark, source, frame.schema, max_files=1))
    books = jobs.accounted(spark, lambda: jobs.keep_updates(jobs.live_timeline(stream, "10 minutes"), out, mark, "available-now"))
    assert sum(r.rows_in for r in books.collect()) == 6 and sum(r.dropped for r in books.collect()) == 1
    assert jobs.current_rows(spark, out, ["minute", "emotion"]).agg(F.sum("count")).first()[0] == 5


def test_supervised_pair(spark, tmp_path):
    source = str(tmp_path / "in")
    feed(spark.range(3), source, ["true"])
    stream = stream_events(spark, source, spark.range(1).schema)
    bad = stream.withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("a two"))).otherwise(F.col("id")))

    def start(rows, name, trigger):
        return files.append_stream(rows, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-mark"), trigger, partition_by=None)

    ends = jobs.supervise({"good": start(stream, "good", "100 milliseconds"), "bad": start(bad, "bad", "100 milliseconds")})
    assert [e[:2] for e in ends] == [("good", "stopped"), ("bad", "failed")] and "a two" in ends[1][2]
    assert jobs.supervise({"once": start(stream, "once", "available-now")}) == [("once", "finished", None)]


def test_another_model_starts_afresh():
    import numpy as np

    first = SmoothFold(("k",), ("n",), "xyz", LiveSettings(vote_window=3), model="first")
    state, _ = first.run(first.start(), {"probs": np.array([[1.0, 0.0, 0.0]] * 4)}, 4)
    rows = {"probs": np.array([[0.0, 0.0, 1.0]])}
    assert first.run(state, rows, 1)[1]["vote_label"] == ["x"]
    second = SmoothFold(("k",), ("n",), "xyz", LiveSettings(vote_window=3), model="second")
    assert second.run(state, rows, 1)[1] == second.run(second.start(), rows, 1)[1]


@pytest.mark.parametrize("name, size", [("stream_hold", 200), ("stream_track", 800), ("stream_late_rows", 200), ("stream_vote_change", 100)])
def test_a_trigger_does_not_grow_with_the_table(spark, folder, monkeypatch, name, size):
    read = []
    real = queries.stream_events

    def counted(spark, path, schema, max_files=None):
        assert max_files == 1
        read.extend(spark.read.schema(schema).parquet(path).groupBy(F.input_file_name()).count().toPandas()["count"])
        return real(spark, path, schema, max_files)

    whole = sorted(map(str, queries.QUERIES[name](spark, folder).collect()))
    monkeypatch.setattr(queries, "stream_events", counted)
    monkeypatch.setattr(queries, "ROWS_PER_TRIGGER", size)
    assert sorted(map(str, queries.QUERIES[name](spark, folder).collect())) == whole
    assert len(read) > queries.PARTS and max(read) < 2 * size


def test_files_of_a_stream_are_written_by_few_jobs(spark, folder, monkeypatch):
    """One job per file, one after the other, took longer than the table had rows for."""
    monkeypatch.setattr(queries, "ROWS_PER_TRIGGER", 100)
    found = queries.stored(views.detections(spark, folder, cameras=4), "few-jobs")
    context, group = spark.sparkContext, "few-jobs"
    context.setJobGroup(group, "files of a stream")
    stream = queries._as_stream(found, "few-jobs", queries._by_time(found, "ts"), "ts")
    jobs_run = len(context.statusTracker().getJobIdsForGroup(group))
    context.setLocalProperty("spark.jobGroup.id", None)
    read = []
    query = stream.writeStream.foreachBatch(lambda rows, _: read.append(rows.agg(F.min("ts"), F.max("ts"), F.count("*")).first())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(read) > 50 and jobs_run < len(read) and sum(n for *_, n in read) == found.count()
    assert all(before < after for (_, before, _), (after, _, _) in zip(read, read[1:]))


@pytest.mark.parametrize("keeps_times", [True, False])
def test_files_are_read_in_turn(spark, tmp_path, monkeypatch, keeps_times):
    path = str(tmp_path / "in")
    if not keeps_times:
        monkeypatch.setattr(files, "_data_files", lambda store, place, real=files._data_files: dict.fromkeys(real(store, place), 0))
    table = spark.range(0, 200, 1, 4)
    first = [table.where(F.col("id") % 2 == n).where("id < 100").repartitionByRange(3, "id") for n in (1, 0)]
    files.append_in_turn([*first, table.where("id < 0").coalesce(1)], path)
    files.append_in_turn([table.where("id >= 100").coalesce(1)], path)
    read = []
    stream = stream_events(spark, path, table.schema, max_files=1)
    query = stream.writeStream.foreachBatch(lambda rows, _: read.append([r.id for r in rows.collect()])).trigger(availableNow=True).start()
    query.awaitTermination()
    read = [sorted(ids) for ids in read if ids]
    assert [i for ids in read for i in ids] == [*range(1, 100, 2), *range(0, 100, 2), *range(100, 200)] and len(read) == 7


def test_stream_of_nulls_late_rows_and_several_keys(spark, tmp_path):
    """Rows come packed to the state: each keeps its key, its columns and its own outputs."""
    rows = [(None, 1.0, 1, 1, "a"), ("b", None, 2, 1, None), ("b", 1.0, 3, 1, "c"), (None, 1.2, 4, 1, "d"), ("b", 0.5, 5, 1, "late"), ("b", 1.9, 6, 1, None), ("e", 0.1, 7, 1, "f"), (None, 0.9, 8, 1, "late")]
    frame = spark.createDataFrame(rows, "source_id string, t double, frame_id long, face_id long, note string")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    fold = ThrottleFold(("source_id",), "t", ("frame_id", "face_id"), 0.5)
    for part in ("frame_id < 5", "frame_id >= 5"):
        feed(frame.repartition(3), source, [part])
        run(fold_stream(stream_events(spark, source, frame.schema), fold), out, mark, partition_by="late")
    done = spark.read.schema(f"{frame._jdf.schema().toDDL()}, passed boolean, late boolean").parquet(out)
    assert sorted(done.select(frame.columns).collect(), key=lambda r: r.frame_id) == sorted(map(tuple, rows), key=lambda r: r[2])
    assert {r.frame_id: r.passed for r in done.where("not late").collect()} == {1: True, 2: False, 3: True, 4: False, 6: True, 7: True}
    assert {(r.frame_id, r.passed, r.note) for r in done.where("late").collect()} == {(5, None, "late"), (8, None, "late")}


def walked(fold, rows, cuts, crowd, monkeypatch):
    monkeypatch.setattr(tracking, "CROWD", crowd)
    state, numbers = fold.start(), []
    for low, high in zip(cuts, cuts[1:]):
        state, made = fold.run(json.loads(json.dumps(state)), {name: values[low:high] for name, values in rows.items()}, high - low)
        numbers += list(made["track_id"])
    return json.dumps(state), numbers


@pytest.mark.parametrize("seed", range(12))
def test_tracks_matched_at_once_are_those_walked_box_by_box(monkeypatch, seed):
    rng = random.Random(seed)
    time, rows = 0.0, []
    for frame in range(150):
        time += rng.choice([0.0, 0.3, 0.4, 0.9, 2.0])
        for n in range(rng.choice([1, 2, 6])):
            again = rows and rng.random() < 0.3  # equal boxes make ties
            rows.append((time, frame, n, *(rows[-rng.randint(1, min(len(rows), 9))][3:] if again else (rng.randrange(90), rng.randrange(90), rng.randint(20, 60), rng.randint(20, 60)))))
    columns = {name: np.array(values) for name, values in zip(("ts", "frame_id", "det_no", "x", "y", "w", "h"), zip(*rows))}
    cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(5))})
    one_by_one = walked(TrackFold(), columns, cuts, -1, monkeypatch)
    monkeypatch.setattr(tracking, "SLICE", rng.choice([1, 50, 8192]))
    monkeypatch.setattr(tracking, "best_overlap", None)  # no box is compared on its own any more
    assert walked(TrackFold(), columns, cuts, 10**6, monkeypatch) == one_by_one
