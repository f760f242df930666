"""Boxes and matrices on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in BOX]


def union_of(prefix: str = "") -> list[Column]:
    """Aggregates that give the box around all boxes of a group."""
    return [f(prefix + c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX)]


def overlaps(a: list[Column], b: list[Column]) -> Column:
    """Whether two boxes share some area: touching edges don't count."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def area(b: list[Column]) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union; 0 where the union has no area."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def multiply(m: list[Column], n: list[Column]) -> list[Column]:
    """The affine map that does m first, then n; each as a b c d e f."""
    return [
        m[0] * n[0] + m[1] * n[2],
        m[0] * n[1] + m[1] * n[3],
        m[2] * n[0] + m[3] * n[2],
        m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4],
        m[4] * n[1] + m[5] * n[3] + n[5],
    ]
