"""From detections to events: the live path as one composition of table operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LiveSettings
from ..operators import detections as D
from ..operators.scoring import Scorer, score_faces, usable
from ..operators.smoothing import smooth
from ..operators.throttle import throttle
from ..operators.tracking import assign_tracks
from ..schemas import EMOTIONS, EVENT_WIRE
from ..session import stored


def faces_on_frames(
    frames: DataFrame, detections: DataFrame, settings: LiveSettings = LiveSettings(), span: float | None = None
) -> DataFrame:
    """Confident boxes, held over frames that were not searched, cut to the frame, with tracks."""
    shown = D.hold_boxes(frames, D.confident(detections, settings.min_confidence), settings, span)
    boxes = stored(D.clamped(shown), "boxes")
    return assign_tracks(boxes, settings=settings, span=span)


def events_from_faces(
    faces: DataFrame,
    scorer_factory: Callable[[], Scorer],
    features: str = "features",
    labels: Sequence[str] = EMOTIONS,
    settings: LiveSettings = LiveSettings(),
    span: float | None = None,
) -> DataFrame:
    """Score, smooth per track, limit per source, and shape as wire events.

    What the model and the smoothing give is stored: the ordered passes read their input more
    than once, and a face must be scored only once.
    """
    scored = usable(score_faces(faces, scorer_factory, features)).drop(features, "logits", "score_failed")
    track = ["source_id", "track_id"]
    shown = smooth(stored(scored, "scored"), track, ["ts", "frame_id"], labels, settings, span)
    sent = throttle(stored(shown.drop("probs"), "smoothed"), "ts", settings.send_interval, ties=("frame_id", "det_no"), span=span)
    event = {
        "face_id": F.col("track_id"),
        "producer_ts": F.col("ts"),
        "emotion": F.col("stable_label"),
        "score": F.col("stable_score"),
        **{f"bbox_{side}": F.col(side) for side in "xywh"},
    }
    return sent.withColumns(event).select(
        *[F.col(field.name).cast(field.dataType).alias(field.name) for field in EVENT_WIRE]
    )


def frames_to_events(
    frames: DataFrame,
    detections: DataFrame,
    scorer_factory: Callable[[], Scorer],
    features: str = "features",
    labels: Sequence[str] = EMOTIONS,
    settings: LiveSettings = LiveSettings(),
    span: float | None = None,
) -> DataFrame:
    """``detections`` carry a feature vector per box; the result feeds ingest or a Kafka sink."""
    faces = faces_on_frames(frames, detections, settings, span)
    return events_from_faces(faces, scorer_factory, features, labels, settings, span)
