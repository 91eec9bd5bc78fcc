"""Probability vectors and pixel arrays as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind

# Fixed values.
SOFTMAX_EPSILON = 1e-9
PIXEL_MEAN = 0.5
PIXEL_STD = 0.5
PIXEL_MAX = 255.0


def softmax(logits: Column) -> Column:
    """Stable softmax of an array column, with a small term in the denominator."""

    def scaled(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x) + F.lit(SOFTMAX_EPSILON)
        return bind(total, lambda t: F.transform(powers, lambda x: x / t))

    return bind(
        F.array_max(logits),
        lambda top: bind(F.transform(logits, lambda x: F.exp(x - top)), scaled),
    )


def argmax(values: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def normalise_pixels(pixels: Column, mean: float = PIXEL_MEAN, std: float = PIXEL_STD) -> Column:
    return F.transform(pixels, lambda p: (p / F.lit(PIXEL_MAX) - F.lit(mean)) / F.lit(std))


def gray_to_channels(pixels: Column, channels: int = 3) -> Column:
    """The same gray plane once per channel, channel-major."""
    return F.flatten(F.array(*[pixels] * channels))
