"""Box geometry on columns. Boxes are four columns; all arithmetic is DOUBLE."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: floor for a zero union or a zero enclosing area.
TINY_AREA = 1e-7


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    def named(self, *names: str) -> list[Column]:
        labels = names or ("x1", "y1", "x2", "y2")
        return [c.alias(n) for c, n in zip(self, labels)]


def box(prefix: str = "", suffix: str = "") -> Box:
    """The box stored in columns x1, y1, x2, y2, with an optional prefix and suffix."""
    return Box(*[F.col(f"{prefix}{n}{suffix}") for n in ("x1", "y1", "x2", "y2")])


def clip(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(value, low), high)


def cxcywh_to_xyxy(cx: Column, cy: Column, w: Column, h: Column, clamp_size: bool = True) -> Box:
    """Centre form to corner form; a negative size counts as zero unless *clamp_size* is off."""
    zero = F.lit(0.0)
    w, h = (F.greatest(w, zero), F.greatest(h, zero)) if clamp_size else (w, h)
    return Box(cx - w * 0.5, cy - h * 0.5, cx + w * 0.5, cy + h * 0.5)


def xyxy_to_cxcywh(b: Box) -> tuple[Column, Column, Column, Column]:
    return (b.x1 + b.x2) / 2.0, (b.y1 + b.y2) / 2.0, b.x2 - b.x1, b.y2 - b.y1


def xyxy_to_xywh(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.x1, b.y1, b.x2 - b.x1, b.y2 - b.y1


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def scale(b: Box, sx: Column, sy: Column) -> Box:
    return Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy)


def clamp_to(b: Box, width: Column, height: Column) -> Box:
    return Box(clip(b.x1, 0.0, width), clip(b.y1, 0.0, height), clip(b.x2, 0.0, width), clip(b.y2, 0.0, height))


def area(b: Box) -> Column:
    return (b.x2 - b.x1) * (b.y2 - b.y1)


def has_area(b: Box) -> Column:
    return (b.x2 > b.x1) & (b.y2 > b.y1)


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), zero)
    h = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), zero)
    return w * h


def union_area(a: Box, b: Box) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; only a vanishing union is replaced, so equal boxes give exactly 1."""
    return intersection(a, b) / F.greatest(union_area(a, b), F.lit(TINY_AREA))


def coverage(detection: Box, region: Box) -> Column:
    """Intersection over the detection's own area: the crowd rule of the published evaluation protocol."""
    own = area(detection)
    return F.when(own > 0, intersection(detection, region) / own).otherwise(F.lit(0.0))


def giou(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(F.greatest(a.x2, b.x2) - F.least(a.x1, b.x1), zero)
    h = F.greatest(F.greatest(a.y2, b.y2) - F.least(a.y1, b.y1), zero)
    hull = w * h
    return iou(a, b) - (hull - union_area(a, b)) / F.greatest(hull, F.lit(TINY_AREA))


def l1_distance(left, right) -> Column:
    total = F.abs(left[0] - right[0])
    for a, b in zip(left[1:], right[1:]):
        total = total + F.abs(a - b)
    return total


def flip_horizontal(b: Box, width: Column) -> Box:
    return Box(width - b.x2, b.y1, width - b.x1, b.y2)


def shift(b: Box, dx, dy) -> Box:
    return Box(b.x1 - dx, b.y1 - dy, b.x2 - dx, b.y2 - dy)
