"""Box arithmetic on columns. A box is x, y (top-left pixel), w, h."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DEFAULT_CONFIDENCE = 0.8
MIN_CONFIDENCE = 0.45
RESIZE_WIDTH = 640


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def named(cls, prefix: str = "", suffix: str = "") -> "Box":
        return cls(*[F.col(f"{prefix}{side}{suffix}") for side in ("x", "y", "w", "h")])


def relative_to_pixels(box: Box, frame_w: Column, frame_h: Column) -> Box:
    """Fractions of the frame to whole pixels, truncated."""
    return Box(
        (box.x * frame_w).cast("int"),
        (box.y * frame_h).cast("int"),
        (box.w * frame_w).cast("int"),
        (box.h * frame_h).cast("int"),
    )


def from_resized(box: Box, frame_w: Column, resize_width: int = RESIZE_WIDTH) -> Box:
    """A box found on a frame shrunk to ``resize_width`` back to the original pixels."""
    inverse = F.lit(1.0) / F.least(F.lit(1.0), F.lit(float(resize_width)) / frame_w)
    return Box(*[(side * inverse).cast("int") for side in box])


def clamp(box: Box, frame_w: Column, frame_h: Column, width_from_raw: bool = False) -> Box:
    """The part of a box inside the frame; w or h is 0 or less when nothing is left.

    The right edge counts from the clamped left edge, or from the raw one with
    ``width_from_raw``.
    """
    left, top = F.greatest(F.lit(0), box.x), F.greatest(F.lit(0), box.y)
    from_x, from_y = (box.x, box.y) if width_from_raw else (left, top)
    right, bottom = F.least(frame_w, from_x + box.w), F.least(frame_h, from_y + box.h)
    return Box(left, top, right - left, bottom - top)


def overlap(a: Box, b: Box) -> Column:
    """Intersection over union; 0 when the union is empty."""
    a, b = Box(*[side.cast("bigint") for side in a]), Box(*[side.cast("bigint") for side in b])
    wide = F.greatest(F.lit(0), F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x))
    high = F.greatest(F.lit(0), F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y))
    shared = (wide * high).cast("double")
    union = a.w * a.h + b.w * b.h - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def confidence(value: Column, default: float = DEFAULT_CONFIDENCE) -> Column:
    return F.coalesce(value, F.lit(default))
