"""Detections: sampling, confidence, numbering, best box, held boxes, overlap with the frame before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LiveSettings
from ..functions import boxes
from ..functions.boxes import Box
from .folds import Body, Columns, Fold, State, before, bodies
from .ordered import Bucketed, bucketed, last_known, running_count, trailing

FRAME_KEYS = ("source_id", "frame_id")


def sampled_frames(frames: DataFrame, every_n: int) -> DataFrame:
    """Every n-th frame by its number."""
    return frames.where(is_sampled(F.col("frame_id"), every_n))


def is_sampled(frame_id: Column, every_n: int) -> Column:
    return frame_id % F.lit(max(1, every_n)) == 0


def confident(
    detections: DataFrame, least: float = boxes.MIN_CONFIDENCE, default: float = boxes.DEFAULT_CONFIDENCE
) -> DataFrame:
    """Detections of at least ``least`` confidence; a missing one counts as ``default``."""
    filled = detections.withColumn("conf", boxes.confidence(F.col("conf"), default))
    return filled.where(F.col("conf") >= F.lit(least))


def clamped(detections: DataFrame, width_from_raw: bool = False) -> DataFrame:
    """Boxes cut to their frame; boxes with nothing left inside are dropped."""
    inside = boxes.clamp(Box.named(), F.col("frame_w"), F.col("frame_h"), width_from_raw)
    cut = detections.withColumns(dict(zip("xywh", inside)))
    return cut.where((F.col("w") > 0) & (F.col("h") > 0))


def numbered_faces(
    detections: DataFrame, order: Sequence[str], keys: Sequence[str] = FRAME_KEYS, name: str = "face_id"
) -> DataFrame:
    """1-based position of each box in its frame, counted before any box is dropped.

    A frame is one picture with few boxes, so its rows are numbered where they meet, at every size of the table.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return detections.withColumn(name, position.cast("bigint"))


def numbered_frames(
    frames: DataFrame, order: Sequence[str] = ("ts", "frame_id"), span: float | None = None
) -> DataFrame:
    """Running frame number of each source."""
    return running_count(bucketed(frames, ["source_id"], order, span), "frame_no")


def best_detection(detections: DataFrame, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """The detection of highest confidence per frame, the lower ``det_no`` on a tie."""
    rest = [name for name in detections.columns if name not in keys]
    rank = F.struct(F.coalesce("conf", F.lit(float("-inf"))), -F.col("det_no"))
    best = detections.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_best"))
    return best.select(*keys, "_best.*")


def hold_boxes(
    frames: DataFrame,
    detections: DataFrame,
    settings: LiveSettings = LiveSettings(),
    span: float | None = None,
) -> DataFrame:
    """Boxes per frame, where only every n-th frame was searched for faces.

    A frame that was not searched shows the boxes of the newest searched frame, if that is at
    most ``hold_ms`` old. A searched frame without boxes is shown, and held, as empty. Frames
    (source_id, frame_id, ts) carry only the number of the searched frame through the ordered
    pass; its boxes are joined afterwards. ``held_from`` tells where the boxes come from.
    """
    searched = F.when(is_sampled(F.col("frame_id"), settings.detect_every_n), F.struct("ts", "frame_id"))
    marked = frames.select("source_id", "frame_id", "ts", searched.alias("_searched"))
    parts = bucketed(marked, ["source_id"], ["ts", "frame_id"], span)
    known = last_known(parts, "_searched", "_from")
    age_ms = (F.col("ts") - F.col("_from.ts")) * F.lit(1000.0)
    fresh = (F.col("_from.frame_id") == F.col("frame_id")) | (age_ms <= F.lit(max(0.0, settings.hold_ms)))
    shown = known.where(fresh).select("source_id", "frame_id", "ts", F.col("_from.frame_id").alias("held_from"))
    found = sampled_frames(detections, settings.detect_every_n).withColumnRenamed("frame_id", "held_from").drop("ts")
    return shown.join(found, ["source_id", "held_from"])


class HoldFold(Fold):
    """``hold_boxes`` for a stream of one row per frame, its boxes as JSON text (``boxes``).

    ``shown`` is the JSON of the boxes to show, "[]" for none.
    """

    NONE = "[]"

    def __init__(self, settings: LiveSettings = LiveSettings(), keys: Sequence[str] = ("source_id",)):
        self.keys, self.order, self.inputs = tuple(keys), ("ts", "frame_id"), ("boxes",)
        self.outputs = T.StructType(
            [T.StructField("shown", T.StringType()), T.StructField("held_from", T.LongType())]
        )
        self.every_n, self.hold_ms = max(1, settings.detect_every_n), max(0.0, settings.hold_ms)

    def start(self) -> State:
        return {"boxes": self.NONE, "ts": None, "frame_id": None}

    def run(self, state: State, rows: Columns, size: int) -> tuple[State, Columns]:
        boxes, since, origin = state["boxes"], state["ts"], state["frame_id"]
        shown, held_from = [], []
        for time, frame, found in zip(rows["ts"].tolist(), rows["frame_id"].tolist(), rows["boxes"]):
            if frame % self.every_n == 0:
                boxes, since, origin = found or self.NONE, time, frame
            held = since is not None and (origin == frame or (time - since) * 1000.0 <= self.hold_ms)
            shown.append(boxes if held else self.NONE)
            held_from.append(origin if held else None)
        return {"boxes": boxes, "ts": since, "frame_id": origin}, {"shown": shown, "held_from": held_from}

    def heads(self, parts: Bucketed) -> DataFrame:
        """The newest searched frame of each bucket."""
        compose = lambda a, b: b if b["ts"] is not None else a
        sum_up = lambda state, rows, size: (state, self.run(self.start(), rows, size)[0])
        return before(bodies(parts, self, sum_up, compose), parts.keys, compose)

    def enter(self, state: State, head: Body) -> State:
        return head


def matches_before(detections: DataFrame, least: float = LiveSettings.match_overlap, span: float | None = None) -> DataFrame:
    """Each box with the box of the frame before it overlaps most, at least ``least``; the lower ``det_no`` on a tie. One row
    per matched box.

    The frame before is the last one of the source that has boxes, whatever its number. Boxes are put together by frame, as one
    picture holds few of them; frames then look back one row within their source.
    """
    if least <= 0:
        raise ValueError("least must be positive: boxes that do not overlap are not compared")
    columns = [name for name in detections.columns if name not in FRAME_KEYS]
    pictures = detections.groupBy(*FRAME_KEYS).agg(F.collect_list(F.struct(*columns)).alias("_boxes"))
    seen = trailing(pictures, ["source_id"], ["frame_id"], 2, {"_seen": lambda w: F.collect_list("_boxes").over(w)}, span)
    pairs = seen.where(F.size("_seen") == 2).select(*FRAME_KEYS, F.explode("_boxes").alias("_box"), F.get("_seen", F.lit(0)).alias("_before"))
    mine = Box(*(F.col(f"_box.{side}") for side in "xywh"))

    def scored(other: Column) -> Column:
        iou = boxes.overlap(mine, Box(other.x, other.y, other.w, other.h))
        return F.struct(iou.alias("iou"), (-other.det_no).alias("behind"))

    # Exploded from an array of one, so that it is worked out once and not again in the filter and in each column.
    best = pairs.select(*FRAME_KEYS, "_box", F.explode(F.array(F.array_max(F.transform("_before", scored)))).alias("_best")).where(F.col("_best.iou") >= F.lit(least))
    shown = [F.col(f"_box.{name}").alias(name) for name in columns]
    return best.select(*FRAME_KEYS, *shown, (-F.col("_best.behind")).alias("prev_det_no"), F.col("_best.iou").alias("iou"))
