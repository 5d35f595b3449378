"""Annotation geometry under resize, flip and crop. Row-local: no shuffle beyond the size lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.functions import boxes as bx
from gridmark.functions import points as pt


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def resized_shape(height: Column, width: Column, size: int, max_size: int | None = None) -> tuple[Column, Column]:
    """Shape with the short side at *size*, reduced so the long side stays within *max_size*. Rounds half to even."""
    h, w = height.cast("double"), width.cast("double")
    short, long = F.least(h, w), F.greatest(h, w)
    target = F.lit(float(size))
    if max_size is not None:
        limited = F.bround(F.lit(float(max_size)) * short / long)
        target = F.when(long / short * F.lit(float(size)) > max_size, limited).otherwise(target)
    unchanged = ((w <= h) & (w == target)) | ((h <= w) & (h == target))
    new_w = F.when(unchanged, w).when(w < h, target).otherwise(F.bround(target * w / h))
    new_h = F.when(unchanged, h).when(w < h, F.bround(target * h / w)).otherwise(target)
    return new_h.cast("int"), new_w.cast("int")


def resize(targets: DataFrame, new_height: Column, new_width: Column) -> DataFrame:
    """Targets with ``width`` and ``height`` resized; area by the product of both ratios."""
    ratio_w = new_width.cast("double") / _double("width")
    ratio_h = new_height.cast("double") / _double("height")
    staged = targets.withColumns({"_nw": new_width, "_nh": new_height, "_rw": ratio_w, "_rh": ratio_h})
    box = bx.scale(bx.box(), F.col("_rw"), F.col("_rh"))
    changed = dict(zip(("x1", "y1", "x2", "y2"), box))
    changed["area"] = F.col("area") * (F.col("_rw") * F.col("_rh"))
    if "keypoints" in targets.columns:
        changed["keypoints"] = pt.resize_points(
            F.col("keypoints"), _double("width"), _double("height"), _double("_nw"), _double("_nh")
        )
    # The size is replaced in its own step: inside array lambdas a replaced column would be read instead of the old one.
    resized = staged.withColumns(changed).withColumns({"width": F.col("_nw"), "height": F.col("_nh")})
    return resized.drop("_nw", "_nh", "_rw", "_rh")


def flip_draw(key: Column, seed: int, probability: float = 0.5) -> Column:
    """Reproducible draw per row key, independent of partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(probability * 1_000_000)


def flip(targets: DataFrame, when: Column | None = None, pairs: Sequence[int] = ()) -> DataFrame:
    """Mirror boxes and keypoints left to right on rows where *when* holds."""
    when = F.lit(True) if when is None else when
    mirrored = bx.flip_horizontal(bx.box(), _double("width"))
    changed = {n: F.when(when, c).otherwise(F.col(n)) for n, c in zip(("x1", "y1", "x2", "y2"), mirrored)}
    if "keypoints" in targets.columns:
        points = pt.flip_points(F.col("keypoints"), _double("width"), _double("height"), pairs)
        changed["keypoints"] = F.when(when, points).otherwise(F.col("keypoints"))
    return targets.withColumns(changed)


def clean(targets: DataFrame, width: Column, height: Column) -> DataFrame:
    """Clamp to the canvas, drop empty boxes, recompute areas, zero points outside."""
    staged = targets.withColumns({"_cw": width.cast("double"), "_ch": height.cast("double")})
    box = bx.clamp_to(bx.box(), F.col("_cw"), F.col("_ch"))
    changed = dict(zip(("x1", "y1", "x2", "y2"), box))
    if "keypoints" in targets.columns:
        changed["keypoints"] = pt.zero_outside(F.col("keypoints"), F.col("_cw"), F.col("_ch"))
    kept = staged.withColumns(changed).filter(bx.has_area(bx.box()))
    return kept.withColumn("area", bx.area(bx.box())).drop("_cw", "_ch")


def crop(targets: DataFrame, left: Column, top: Column, width: Column, height: Column) -> DataFrame:
    """Shift into the crop window, then clean against it. ``width`` and ``height`` become the window's."""
    staged = targets.withColumns({"_l": left.cast("double"), "_t": top.cast("double"), "_w": width, "_h": height})
    changed = dict(zip(("x1", "y1", "x2", "y2"), bx.shift(bx.box(), F.col("_l"), F.col("_t"))))
    if "keypoints" in targets.columns:
        moved = pt.shift_points(F.col("keypoints"), F.col("_l"), F.col("_t"), _double("_w"), _double("_h"))
        changed["keypoints"] = moved
    shifted = staged.withColumns(changed)
    cleaned = clean(shifted, F.col("_w"), F.col("_h"))
    return cleaned.withColumns({"width": F.col("_w"), "height": F.col("_h")}).drop("_l", "_t", "_w", "_h")
