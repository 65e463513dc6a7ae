"""Column functions over rectangles given as left, top, right, bottom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length two intervals share, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def area(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.greatest(F.lit(0.0), right - left) * F.greatest(F.lit(0.0), bottom - top)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = overlap(a[0], a[2], b[0], b[2]) * overlap(a[1], a[3], b[1], b[3])
    union = area(*a) + area(*b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def touches(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Closed intersection: rectangles that only touch count."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def crosses(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Open intersection: rectangles that only touch do not count."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])
