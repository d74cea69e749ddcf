"""Numeric expressions of training, inference and display."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def soft_threshold(z: Column, t: float) -> Column:
    return F.signum(z) * F.greatest(F.abs(z) - t, F.lit(0.0))


def softmax(value: Column, *by: str) -> Column:
    """exp(value) over its sum within the group; groups are the models of one site."""
    group = Window.partitionBy(*by)
    scaled = F.exp(value - F.max(value).over(group))
    return scaled / F.sum(scaled).over(group)


def heat_color(value: Column, low: float = -0.4, high: float = 0.4) -> Column:
    """`#rrggbb` from blue over black (0) to yellow, values clamped to [low, high], channels cut to whole
    numbers."""
    up, down = F.least(value / high, F.lit(1.0)), F.least(value / low, F.lit(1.0))
    channel = lambda part: F.floor(255 * F.greatest(part, F.lit(0.0))).cast("int")
    return F.format_string("#%02x%02x%02x", channel(up), channel(up), channel(down))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
