"""Boxes, points and intervals as column expressions. A box is four columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", frame: DataFrame | None = None) -> Box:
    col = (lambda c: frame[c]) if frame is not None else F.col
    return tuple(col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def iou_guessing(a: Box, b: Box) -> Column:
    """The variant that reads a box as x, y, width, height wherever its third and fourth
    numbers are positive, which ordinary corner boxes are too."""
    as_corners = lambda x: (x[0], x[1], F.when(x[2] > 0, x[0] + x[2]).otherwise(x[2]), F.when(x[3] > 0, x[1] + x[3]).otherwise(x[3]))
    return iou(as_corners(a), as_corners(b))


def overlaps(a: Box, b: Box) -> Column:
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def contains_point(b: Box, x: Column, y: Column) -> Column:
    return (b[0] <= x) & (x <= b[2]) & (b[1] <= y) & (y <= b[3])


def ordered(b: Box) -> Box:
    return F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3])


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def to_pixels(b: Box, width: Column, height: Column) -> Box:
    """Relative to absolute corners, cut to whole numbers."""
    return tuple(F.floor(v * s).cast("int") for v, s in zip(b, (width, height, width, height)))  # type: ignore[return-value]


def polygon_box(points: Column) -> Box:
    """Bounding box of an array of structs x, y."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def point_distance_score(x: Column, y: Column, tx: Column, ty: Column) -> Column:
    """1 - distance on points in the unit square; 0 outside of it or for nulls."""
    inside = x.between(0, 1) & y.between(0, 1)
    return F.when(inside, F.greatest(F.lit(0.0), 1 - F.hypot(x - tx, y - ty))).otherwise(0.0)


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap by union; 0 where the union is empty."""
    inter = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    union = (e1 - s1) + (e2 - s2) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def interval_hull_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap by hull: differs from the union where the intervals lie apart."""
    inter = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, inter / hull).otherwise(0.0)


def distance_ratio(p: Column, g: Column, limit: float) -> Column:
    """Whether the larger of the two quotients is below the limit."""
    return F.when((p > 0) & (g > 0), F.greatest(p / g, g / p) < limit).otherwise(False)
