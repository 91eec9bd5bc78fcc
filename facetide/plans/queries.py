"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LiveSettings
from ..functions import boxes, probs, text, times
from ..functions.boxes import Box
from ..operators import detections as D
from ..operators import evaluation as E
from ..operators.scoring import score_faces, usable, with_labels
from ..operators.smoothing import CandidateFold, SmoothFold, average_probs, smooth, switch_labels, vote_labels
from ..operators.throttle import ThrottleFold, throttle
from ..operators.tracking import TrackFold, assign_tracks
from ..schemas import EMOTIONS
from ..session import fresh_folder, prepare, stored
from ..sinks.files import append_in_turn, append_stream, append_to_both, compact_dates, write_labels
from ..sources import labels as label_source
from ..sources.store import read_events, stream_events, union_events
from ..streaming import jobs
from ..streaming.stateful import fold_stream, late_rows, timely
from . import analytics, ingest, live, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Events of the given tables are minutes apart, so windows and intervals are wide here.
WINDOW_MINUTES = 7 * 1440
THROTTLE_SECONDS = 1800.0
SMOOTHING = LiveSettings(vote_window=5, min_score=0.2, confirm_frames=2)
LABELLED = EMOTIONS[:7]  # leaves class 7 without a name


def query(make: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return make(prepare(spark), folder)

    QUERIES[make.__name__] = run
    return make


# Ingest


@query
def ingest_enrich(spark, folder):
    raw = views.messages(views.table(spark, folder, "events"))
    return ingest.ingest(raw, arrival="timestamp")


@query
def ingest_unclamped_latency(spark, folder):
    events = views.emotion_events(spark, folder, clamp=False)
    return events.select("source_id", "frame_id", "producer_ts_sec", "e2e_latency_ms")


@query
def json_props_parse(spark, folder):
    raw = views.table(spark, folder, "events").select("event_id", F.col("props").cast("binary").alias("value"))
    return ingest.parse_messages(raw, T.StructType([T.StructField("k", T.IntegerType())]), required=(), keep=["event_id"])


@query
def coerce_numeric_ts(spark, folder):
    odd = F.col("event_id") % 3 == 0
    stamp = F.date_format(F.col("ts").cast("timestamp"), times.V1_TIME_PATTERN)
    texts = views.table(spark, folder, "events").select(
        "event_id",
        F.when(odd, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("number_text"),
        F.when(odd, F.lit("soon")).otherwise(stamp).alias("time_text"),
    )
    moment = times.coerce_timestamp(F.col("time_text"), T.StringType())
    return texts.select("event_id", times.number(F.col("number_text")).alias("number"), moment.alias("moment"))


@query
def raw_messages(spark, folder):
    raw = views.messages(views.table(spark, folder, "events"))
    legacy = ingest.raw_messages(raw, F.col("timestamp"))
    kept = legacy.select(text.parse_json(F.col("message"), "frame_id BIGINT, emotion STRING").alias("j"), "event_time")
    return kept.select("j.*", "event_time")


@query
def label_lines(spark, folder):
    documents = views.table(spark, folder, "documents").select("doc_id", "text")
    return label_source.label_table(documents, "text", keep=("doc_id",))


@query
def required_fields(spark, folder):
    """Messages of which some lack a field; the camera, the frame and the score are required."""
    wire = views.wire_events(views.table(spark, folder, "events"))
    value = F.to_json(F.struct("source_id", "frame_id", "emotion", "score")).cast("binary").alias("value")
    schema = T.StructType([wire.schema[name] for name in ("source_id", "frame_id", "emotion", "score")])
    return ingest.parse_messages(wire.select(value), schema, required=("source_id", "frame_id", "score"))


@query
def zoneless_times(spark, folder):
    events = views.emotion_events(spark, folder)
    return events.select("frame_id", times.drop_zone(F.col("event_ts")).alias("event_ts"))


@query
def labelled_folder(spark, folder):
    """Label files of each language's documents, written into a folder of its name and listed again."""
    path = fresh_folder(spark, "labelled")
    documents = views.table(spark, folder, "documents").where("lang IS NOT NULL")
    documents.select("lang", "text").write.partitionBy("lang").parquet(path)  # a file per task and language: no task takes a whole one
    found = label_source.read_labelled_folder(spark, path).where(F.col("path").endswith(".parquet"))
    return found.select(F.regexp_replace("label", "^lang=", "").alias("label")).distinct()


@query
def class_list_files(spark, folder):
    """The class list written as JSON lines and as text; both read back."""
    index = E.class_index(views.table(spark, folder, "documents"), "source")
    as_json, as_text = fresh_folder(spark, "classes-json"), fresh_folder(spark, "classes-text")
    write_labels(index, as_json, as_text)
    lines = spark.read.text(as_text).select(F.lit("text").alias("kind"), F.lit(None).cast("bigint").alias("idx"), F.col("value").alias("label"))
    return spark.read.schema("idx bigint, label string").json(as_json).select(F.lit("json").alias("kind"), "idx", "label").union(lines)


@query
def compacted_store(spark, folder):
    """A store by date, rewritten as fewer files."""
    path = fresh_folder(spark, "compacted")
    compact_dates(read_events(spark, _stored_by_date(spark, folder, "small-files")), path, 50_000)
    return read_events(spark, path).select("source_id", "frame_id", "event_ts", "event_date")


# Analytics


@query
def pick_timestamp(spark, folder):
    events = analytics.normalise(views.emotion_events(spark, folder))
    return analytics.time_counts(events)


@query
def recent_window(spark, folder):
    events = views.emotion_events(spark, folder)
    return analytics.recent(events, WINDOW_MINUTES).select("source_id", "frame_id", "event_ts", "emotion", "score")


@query
def filtered_events(spark, folder):
    events = views.emotion_events(spark, folder)
    kept = analytics.filtered(events, WINDOW_MINUTES, 0.5, "cam_01")
    return kept.select("source_id", "frame_id", "event_ts", "emotion", "score")


@query
def kpi_latency(spark, folder):
    kept = analytics.filtered(views.emotion_events(spark, folder), WINDOW_MINUTES)
    numbers = ("latency_p50", "latency_p95", "processing_p50", "processing_p95")
    return analytics.kpis(kept).withColumns({name: F.round(name, 6) for name in numbers})


@query
def latest_events(spark, folder):
    return analytics.latest(analytics.normalise(views.emotion_events(spark, folder)))


@query
def last_arrived(spark, folder):
    events = views.emotion_events(spark, folder).select("source_id", "frame_id", "face_id", "spark_ts")
    return analytics.last_arrived(events, 20)


@query
def emotion_distribution(spark, folder):
    return analytics.distribution(views.emotion_events(spark, folder))


@query
def emotion_top_k(spark, folder):
    return analytics.top_values(views.emotion_events(spark, folder), "emotion", 3)


@query
def timeline_minute(spark, folder):
    return analytics.timeline(views.emotion_events(spark, folder), F.col("event_ts"))


@query
def timeline_5s(spark, folder):
    return analytics.timeline(views.emotion_events(spark, folder), F.col("event_ts"), step_seconds=5)


@query
def timeline_pivot(spark, folder):
    return analytics.timeline_pivot(views.emotion_events(spark, folder), F.col("event_ts"))


@query
def timeline_legacy_case(spark, folder):
    return analytics.timeline(views.emotion_events(spark, folder), F.col("event_ts"), legacy_case=True)


@query
def distinct_sources(spark, folder):
    return analytics.sources(views.emotion_events(spark, folder))


@query
def union_v1_v2(spark, folder):
    stored = views.emotion_events(spark, folder).drop("spark_ts", "event_minute", "processing_time_ms")
    return union_events(views.events_v1(spark, folder), stored)


@query
def union_drift(spark, folder):
    """Whole numbers of two widths stay numbers; a number against text becomes text."""
    events = views.table(spark, folder, "events")
    narrow = events.select(F.col("event_id").cast("int").alias("n"), F.col("value").cast("float").alias("v"), F.col("user_id").alias("k"))
    wide = events.select((F.col("event_id") + F.lit(1 << 40)).alias("n"), F.col("value").alias("v"), F.col("event_type").alias("k"))
    return union_events(narrow, wide)


def _stored_by_date(spark, folder, name):
    path = fresh_folder(spark, name)
    views.emotion_events(spark, folder).write.partitionBy("event_date").parquet(path)
    return path


@query
def recent_by_date(spark, folder):
    """The recent window over a store partitioned by date, whose old dates are not read."""
    events = read_events(spark, _stored_by_date(spark, folder, "by-date"))
    return analytics.recent(events, WINDOW_MINUTES, date_column="event_date").select("source_id", "frame_id", "event_ts", "emotion", "score")


@query
def store_mixed_depth(spark, folder):
    """A folder with files of narrower numbers at its root, of each date, and in plain sub-folders one and two levels deep whose
    ``note`` is a number or a text, united with a folder that is missing."""
    path = fresh_folder(spark, "mixed")
    events = views.emotion_events(spark, folder)
    quarter = lambda n: events.where(F.col("frame_id") % 4 == n)
    bare = lambda n: quarter(n).drop("event_date")
    quarter(0).write.partitionBy("event_date").parquet(path)
    bare(1).withColumn("frame_id", F.col("frame_id").cast("int")).write.mode("append").parquet(path)
    bare(2).withColumn("note", F.col("emotion")).write.parquet(f"{path}/plain")
    bare(3).withColumn("note", F.col("frame_id").cast("int")).write.parquet(f"{path}/one/two")
    bare(3).write.parquet(f"{path}/one/two/too_deep")
    found = union_events(read_events(spark, path), read_events(spark, fresh_folder(spark, "missing")))
    return found.select("source_id", "frame_id", "face_id", "emotion", "score", "event_ts", "event_date", "note")


@query
def recent_by_clock(spark, folder):
    """The wall-clock window with its clock set to the newest event, in random order as training takes it."""
    events = views.emotion_events(spark, folder)
    newest = F.timestamp_micros(F.lit(analytics.choose_time(events).newest_us))
    kept = analytics.recent_by_clock(events, WINDOW_MINUTES, F.col("event_ts"), newest)
    return E.shuffled(kept.select("source_id", "frame_id", "event_ts"), seed=7)


@query
def frame_rate(spark, folder):
    moment = F.timestamp_millis(F.col("frame_id") * 100)
    return analytics.frame_rate(views.frames(spark, folder), moment)


# Boxes


@query
def bbox_to_pixels(spark, folder):
    lines = views.table(spark, folder, "lineitem")
    relative = Box(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 60, (F.col("l_partkey") % 50) / 60)
    pixels = boxes.relative_to_pixels(relative, F.lit(640), F.lit(480))
    return lines.select("l_orderkey", "l_linenumber", *[side.alias(name) for name, side in zip("xywh", pixels)])


@query
def bbox_rescale(spark, folder):
    found = views.detections(spark, folder)
    full = boxes.from_resized(Box.named(), F.lit(1280) + F.col("frame_id") % 3 * 320)
    return found.select("source_id", "frame_id", "det_no", *[side.alias(name) for name, side in zip("xywh", full)])


@query
def bbox_clamp(spark, folder):
    return D.clamped(views.detections(spark, folder)).select("source_id", "frame_id", "det_no", "x", "y", "w", "h")


@query
def bbox_clamp_raw_edge(spark, folder):
    cut = D.clamped(views.detections(spark, folder), width_from_raw=True)
    return cut.select("source_id", "frame_id", "det_no", "x", "y", "w", "h")


@query
def detection_filter(spark, folder):
    kept = D.confident(D.sampled_frames(views.detections(spark, folder), 3))
    return kept.select("source_id", "frame_id", "det_no", F.round("conf", 6).alias("conf"))


@query
def best_detection(spark, folder):
    best = D.best_detection(views.detections(spark, folder))
    return best.select("source_id", "frame_id", "det_no", "x", "y", "w", "h", F.round("conf", 6).alias("conf"))


@query
def face_position(spark, folder):
    numbered = D.numbered_faces(views.detections(spark, folder), ["det_no"])
    return D.clamped(numbered).select("source_id", "frame_id", "det_no", "face_id")


@query
def frame_counter(spark, folder):
    return D.numbered_frames(views.frames(spark, folder))


@query
def iou_match(spark, folder):
    matched = D.matches_before(D.clamped(views.detections(spark, folder)).select("source_id", "frame_id", "det_no", "x", "y", "w", "h"))
    return matched.select("source_id", "frame_id", "det_no", "prev_det_no", F.round("iou", 6).alias("iou"))


@query
def held_boxes(spark, folder):
    shown = D.hold_boxes(views.frames(spark, folder), views.detections(spark, folder, cameras=4))
    return shown.select("source_id", "frame_id", "held_from", "det_no", "x", "y", "w", "h")


@query
def track_assign(spark, folder):
    found = stored(D.clamped(views.detections(spark, folder)).drop("conf", "frame_w", "frame_h"), "boxes")
    return assign_tracks(found).select("source_id", "frame_id", "det_no", "track_id")


# Probabilities


@query
def softmax_argmax_label(spark, folder):
    names = label_source.label_values(spark, LABELLED)
    named = with_labels(views.face_probs(spark, folder), names)
    return named.select("track_id", "frame_id", "idx", "label", F.round("score", 6).alias("score"))


@query
def pixel_normalise(spark, folder):
    pixels = F.transform("features", lambda x: (x + 1) * F.lit(127.5))
    planes = probs.gray_to_channels(probs.normalise_pixels(pixels))
    spread = views.features(spark, folder).select("frame_id", F.posexplode(planes).alias("pos", "value"))
    return spread.withColumn("value", F.round("value", 6))


@query
def ema_probs(spark, folder):
    averaged = average_probs(views.face_probs(spark, folder), ["source_id", "track_id"], ["frame_id"], 0.65)
    spread = averaged.select("track_id", "frame_id", F.posexplode("ema").alias("class_idx", "value"))
    return spread.withColumn("value", F.round("value", 6))


def _candidates(spark, folder):
    named = with_labels(views.face_probs(spark, folder), label_source.label_values(spark, EMOTIONS))
    return named.select("source_id", "track_id", "frame_id", "label", "score")


@query
def vote_label(spark, folder):
    voted = vote_labels(_candidates(spark, folder), ["source_id", "track_id"], ["frame_id"], "label", 15)
    return voted.select("track_id", "frame_id", "label", "vote_label")


@query
def hysteresis_label(spark, folder):
    offered = _candidates(spark, folder).withColumnsRenamed({"label": "candidate", "score": "candidate_score"})
    shown = switch_labels(offered, ["source_id", "track_id"], ["frame_id"], SMOOTHING)
    return shown.select("track_id", "frame_id", "stable_label", F.round("stable_score", 6).alias("stable_score"))


def _smoothed_columns(shown: DataFrame) -> DataFrame:
    scores = [F.round(name, 6).alias(name) for name in ("ema_score", "stable_score")]
    return shown.select("track_id", "frame_id", "vote_label", "stable_label", *scores)


@query
def smooth_tracks(spark, folder):
    shown = smooth(views.face_probs(spark, folder), ["source_id", "track_id"], ["frame_id"], EMOTIONS, SMOOTHING)
    return _smoothed_columns(shown)


def _timed(events: DataFrame) -> DataFrame:
    return events.select("source_id", "frame_id", "face_id", F.col("event_ts").cast("double").alias("t"), "emotion")


@query
def throttle_events(spark, folder):
    return throttle(stored(_timed(views.emotion_events(spark, folder)), "timed"), "t", THROTTLE_SECONDS)


@query
def throttle_faces(spark, folder):
    events = stored(_timed(views.emotion_events(spark, folder)), "timed")
    return throttle(events, "t", THROTTLE_SECONDS, keys=("source_id", "face_id"), ties=("frame_id",))


def _fixed_scorer():
    def score(features: np.ndarray) -> np.ndarray:
        return 10.0 * features.reshape(len(features), -1, views.CLASSES).sum(axis=1)

    return score


@query
def score_faces_labels(spark, folder):
    scored = usable(score_faces(views.features(spark, folder), _fixed_scorer))
    named = with_labels(scored, label_source.label_values(spark, EMOTIONS))
    return named.select("track_id", "frame_id", "idx", "label", F.round("score", 6).alias("score"))


def _choosy_scorer():
    score = _fixed_scorer()

    def checked(features: np.ndarray) -> np.ndarray:
        if (features[:, 0] < 0).any():
            raise ValueError("a face that cannot be scored")
        return score(features)

    return checked


@query
def bad_faces_skipped(spark, folder):
    """Faces whose first feature is negative make the scorer fail; the others of their batch are scored all the same."""
    scored = usable(score_faces(views.features(spark, folder), _choosy_scorer))
    return scored.select("track_id", "frame_id", F.posexplode("probs").alias("idx", "p")).withColumn("p", F.round("p", 6))


def _box_logits() -> object:
    return lambda features: features


@query
def frame_to_event(spark, folder):
    logit = F.transform(
        F.sequence(F.lit(0), F.lit(views.CLASSES - 1)),
        lambda i: ((F.col("x") * 7 + F.col("y") * 3 + i * 13) % 17).cast("double") / 4,
    )
    found = views.detections(spark, folder, cameras=4).withColumn("features", logit)
    events = live.frames_to_events(views.frames(spark, folder), found, _box_logits)
    return events.withColumn("score", F.round("score", 6))


# Training tables


@query
def class_index(spark, folder):
    return E.class_index(views.table(spark, folder, "documents"), "lang")


@query
def class_weights(spark, folder):
    documents = views.table(spark, folder, "documents").select("lang")
    return E.class_weights(documents, E.class_index(documents, "lang"), "lang")


@query
def accuracy(spark, folder):
    return E.accuracy(views.predictions(spark, folder)).withColumn("accuracy", F.round("accuracy", 6))


@query
def classification_report(spark, folder):
    report = E.classification_report(views.predictions(spark, folder), epoch=5)
    return report.withColumns({name: F.round(name, 6) for name in ("precision", "recall", "f1")})


@query
def best_epoch(spark, folder):
    best = E.best_epoch(E.accuracy(views.predictions(spark, folder)))
    return best.withColumn("best_accuracy", F.round("best_accuracy", 6))


@query
def epoch_improvements(spark, folder):
    better = E.improvements(E.accuracy(views.predictions(spark, folder)))
    return better.withColumns({name: F.round(name, 6) for name in ("accuracy", "best_before")})


@query
def epoch_loss(spark, folder):
    return E.epoch_loss(views.train_log(spark, folder)).withColumn("train_loss", F.round("train_loss", 6))


# Streams


def _table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.readStream.schema(views.table(spark, folder, name).schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


PARTS = 4  # of the streams made from tables; each is one micro-batch or, of a fold, several in order
ROWS_PER_TRIGGER = 500_000  # about, as a fold holds a trigger's rows of a key at once


def _as_stream(rows: DataFrame, purpose: str, part: Column, order: str | None = None) -> DataFrame:
    """``rows`` as a stream of one file per micro-batch; ``part`` (0 to PARTS - 1) tells the part of a row. With ``order`` a
    part of many rows is cut into several files in that order. ``rows`` is read several times, so it should be a stored table."""
    spark, path = rows.sparkSession, fresh_folder(rows.sparkSession, purpose)
    marked = rows.withColumn("_part", part)
    sizes = dict(marked.groupBy("_part").count().collect())  # one row per part
    parts = [(marked.where(F.col("_part") == number).drop("_part"), sizes.get(number, 0)) for number in range(PARTS)]
    append_in_turn([_cut(some, size, order) for some, size in parts], path)
    return stream_events(spark, path, rows.schema, max_files=1)


def _cut(rows: DataFrame, size: int, order: str | None) -> DataFrame:
    """Partitions of about ROWS_PER_TRIGGER rows in ``order``, so what a trigger reads does not grow with the table: Spark's range
    partitions. Rows of one moment stay together; rows without come last."""
    files = -(-size // ROWS_PER_TRIGGER) if order else 1
    return rows.coalesce(1) if files < 2 else rows.repartitionByRange(files, F.col(order).asc_nulls_last())


def _by_time(rows: DataFrame, time: str) -> Column:
    """PARTS stretches of ``time`` of equal length, in order."""
    low, high = rows.agg(F.min(time).cast("double"), F.max(time).cast("double")).first()
    place = (F.col(time).cast("double") - F.lit(low)) * F.lit(PARTS / (high - low or 1.0))
    return F.least(F.floor(place), F.lit(PARTS - 1))


@query
def stream_ingest(spark, folder):
    raw = views.messages(_table_stream(spark, folder, "events"))
    return jobs.run_to_end(ingest.ingest(raw, arrival="timestamp"), "stream-ingest", "event_date")


@query
def stream_to_both(spark, folder):
    """One stream into two folders by the default trigger's bounded form; both are read back."""
    raw = views.messages(_table_stream(spark, folder, "events"))
    events = ingest.ingest(raw, arrival="timestamp").select("source_id", "frame_id", "emotion")
    places = [(fresh_folder(spark, "both"), fresh_folder(spark, "both-progress")) for _ in range(2)]
    for running in append_to_both(events, *places, trigger="available-now"):
        running.awaitTermination()
    first, second = (spark.read.schema(events.schema).parquet(path).withColumn("place", F.lit(n)) for n, (path, _) in enumerate(places))
    return first.union(second)


@query
def stream_timeline(spark, folder):
    raw = views.messages(views.table(spark, folder, "events"))
    events = ingest.ingest(_as_stream(stored(raw, "raw-rows"), "raw", _by_time(raw, "timestamp")), arrival="timestamp")
    path, mark = fresh_folder(spark, "stream-timeline"), fresh_folder(spark, "stream-timeline-progress")
    jobs.keep_updates(jobs.live_timeline(events), path, mark, "available-now").awaitTermination()
    return jobs.current_rows(spark, path, ["minute", "emotion"])


@query
def stream_watermark_account(spark, folder):
    """A timeline of events that come in disorder: every part holds events of all times, so most are behind the watermark
    from the third part on (Spark drops by the watermark that the batch before began with). All rows are accounted for."""
    events = views.emotion_events(spark, folder).where("emotion IS NOT NULL").select("event_ts", "emotion", "frame_id")
    stream = jobs.counted_input(_as_stream(stored(events, "disorder-rows"), "disorder", F.col("frame_id") % PARTS))
    path, mark = fresh_folder(spark, "account"), fresh_folder(spark, "account-progress")
    books = jobs.accounted(spark, lambda: jobs.keep_updates(jobs.live_timeline(stream, "1 day"), path, mark, "available-now"))
    kept = jobs.current_rows(spark, path, ["minute", "emotion"]).agg(F.sum("count").alias("n_kept"))
    taken = books.agg(F.sum("rows_in").alias("n_input"), F.sum("dropped").alias("groups_dropped"))
    return taken.crossJoin(kept).select("n_input", "n_kept", (F.col("n_input") - F.col("n_kept")).alias("n_dropped"), "groups_dropped")  # one row each


@query
def stream_pair_outcome(spark, folder):
    """Two streams over the same events: one keeps them, one fails on the first without a score, which stops the other."""
    events = views.emotion_events(spark, folder).select("source_id", "frame_id", "score")
    stream = _as_stream(stored(events, "pair-rows"), "pair", F.col("frame_id") % PARTS)
    strict = stream.withColumn("score", F.coalesce("score", F.raise_error(F.lit("an event has no score")).cast("double")))
    places = [(fresh_folder(spark, "pair"), fresh_folder(spark, "pair-progress")) for _ in range(2)]
    running = {name: append_stream(rows, *place, "100 milliseconds", None) for name, rows, place in (("keep", stream, places[0]), ("strict", strict, places[1]))}
    ends = [(name, outcome, "an event has no score" in (error or "")) for name, outcome, error in jobs.supervise(running)]
    return spark.createDataFrame(ends, "name string, outcome string, told boolean")


@query
def stream_frame_rate(spark, folder):
    moment = F.timestamp_millis(F.col("o_orderkey") * 100).alias("ts")
    frames = _table_stream(spark, folder, "orders").select(views.camera(F.col("o_orderkey")).alias("source_id"), moment)
    path, mark = fresh_folder(spark, "stream-rate"), fresh_folder(spark, "stream-rate-progress")
    jobs.keep_updates(jobs.live_rate(frames), path, mark, "available-now").awaitTermination()
    return jobs.current_rows(spark, path, ["source_id", "second"])


def _folded(rows: DataFrame, fold, purpose: str) -> DataFrame:
    """The stream's fold run to its end; late rows are kept beside the others, marked ``late``."""
    return jobs.run_to_end(fold_stream(rows, fold), purpose, "late")


@query
def stream_throttle(spark, folder):
    events = _timed(views.emotion_events(spark, folder))
    fold = ThrottleFold(("source_id",), "t", ("frame_id", "face_id"), THROTTLE_SECONDS)
    sent = timely(_folded(_as_stream(stored(events, "timed-rows"), "timed", _by_time(events, "t"), "t"), fold, "stream-throttle"))
    return sent.where("passed").drop("passed")


@query
def stream_late_rows(spark, folder):
    """Events in disorder: how many of each camera were too late for its state, and how many were not."""
    events = _timed(views.emotion_events(spark, folder))
    fold = ThrottleFold(("source_id",), "t", ("frame_id", "face_id"), THROTTLE_SECONDS)
    done = _folded(_as_stream(stored(events, "disorder-rows"), "disorder", F.col("frame_id") % PARTS, "t"), fold, "stream-late")
    late, in_time = (rows.select("source_id", F.lit(n).alias("late")) for n, rows in ((1, late_rows(done)), (0, timely(done))))
    return late.union(in_time).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("late").alias("n_late"))


@query
def stream_smooth(spark, folder):
    vectors = views.face_probs(spark, folder)
    fold = SmoothFold(("source_id", "track_id"), ("frame_id",), EMOTIONS, SMOOTHING)
    stream = _as_stream(stored(vectors, "face-probs-rows"), "face-probs", _by_time(vectors, "frame_id"), "frame_id")
    return _smoothed_columns(timely(_folded(stream, fold, "stream-smooth")).drop("probs"))


@query
def stream_vote_change(spark, folder):
    """A stream that is stopped, and goes on from the same checkpoint with a shorter vote; then again with another model, whose
    faces start afresh."""
    vectors = views.face_probs(spark, folder)
    path, out, mark = (fresh_folder(spark, f"vote-{name}") for name in ("in", "out", "progress"))
    newest = vectors.agg(F.max("frame_id")).first()[0]
    table = stored(vectors.withColumn("_part", F.least(F.floor(F.col("frame_id") * 3 / newest), F.lit(2))), "vote-rows")
    for part, (length, model) in enumerate([(15, "first"), (3, "first"), (3, "second")]):
        rows = table.where(F.col("_part") == part).drop("_part")
        append_in_turn([_cut(rows, rows.count(), "frame_id")], path)
        fold = CandidateFold(("source_id", "track_id"), ("frame_id",), EMOTIONS, LiveSettings(vote_window=length), model=model)
        append_stream(timely(fold_stream(stream_events(spark, path, vectors.schema, max_files=1), fold)), out, mark, "available-now", None).awaitTermination()
    return spark.read.parquet(out).select("track_id", "frame_id", "vote_label", F.round("ema_score", 6).alias("ema_score"))


@query
def stream_hold(spark, folder):
    box = F.struct("det_no", "x", "y", "w", "h")
    found = views.detections(spark, folder, cameras=4).groupBy("source_id", "frame_id")
    per_frame = found.agg(F.to_json(F.sort_array(F.collect_list(box))).alias("boxes"))
    frames = stored(views.frames(spark, folder).join(per_frame, ["source_id", "frame_id"], "left"), "frames")
    shown = timely(_folded(_as_stream(frames, "frames", _by_time(frames, "ts"), "ts"), D.HoldFold(), "stream-hold"))
    parsed = F.from_json("shown", "array<struct<det_no: bigint, x: int, y: int, w: int, h: int>>")
    return shown.where("held_from is not null").select("source_id", "frame_id", "held_from", F.inline(parsed))


@query
def stream_track(spark, folder):
    found = stored(D.clamped(views.detections(spark, folder, cameras=4)).drop("conf", "frame_w", "frame_h"), "boxes")
    tracked = timely(_folded(_as_stream(found, "boxes", _by_time(found, "ts"), "ts"), TrackFold(), "stream-track"))
    return tracked.select("source_id", "frame_id", "det_no", "track_id")
