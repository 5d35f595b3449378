"""Keypoints and polygons kept as flat arrays: x, y, v triples and x, y pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_points(values: Column, fx, fy, keep=None, source=None) -> Column:
    """Rewrite every triple with x -> fx(x), y -> fy(y); triples failing keep(x, y, v) become zeros.

    With *source*, slot -> slot, a triple is made from the one in another slot. Every triple is computed once.
    """

    def read(at: Column) -> Column:
        return F.struct(fx(F.get(values, at * 3)).alias("x"), fy(F.get(values, at * 3 + 1)).alias("y"), F.get(values, at * 3 + 2).alias("v"))

    def rewrite(p: Column) -> Column:
        triple = F.array(p["x"], p["y"], p["v"])
        return triple if keep is None else F.when(keep(p["x"], p["y"], p["v"]), triple).otherwise(F.array(*[F.lit(0.0)] * 3))

    slots = F.transform(F.filter(values, lambda _, i: i % 3 == 0), lambda _, slot: slot if source is None else source(slot))
    # A last triple that is cut short stays as short as it was.
    return F.slice(F.flatten(F.transform(F.transform(slots, read), rewrite)), F.lit(1), F.size(values))


def scale_pairs(values: Column, sx: Column, sy: Column) -> Column:
    return F.transform(values, lambda v, i: F.when(i % 2 == 0, v * sx).otherwise(v * sy))


def scale_polygons(parts: Column, sx: Column, sy: Column) -> Column:
    return F.transform(parts, lambda part: scale_pairs(part, sx, sy))


def scale_points(values: Column, sx: Column, sy: Column) -> Column:
    return map_points(values, lambda x: x * sx, lambda y: y * sy)


def inside_and_visible(width: Column, height: Column):
    """Predicate of visible points inside the closed image rectangle."""
    return lambda x, y, v: (v > 0) & (x >= 0) & (x <= width) & (y >= 0) & (y <= height)


def zero_outside(values: Column, width: Column, height: Column) -> Column:
    return map_points(values, lambda x: x, lambda y: y, inside_and_visible(width, height))


def resize_points(values: Column, width: Column, height: Column, new_width: Column, new_height: Column) -> Column:
    """Multiply then divide, so an edge point lands exactly on the new edge."""
    return map_points(
        values,
        lambda x: x * new_width / width,
        lambda y: y * new_height / height,
        inside_and_visible(new_width, new_height),
    )


def shift_points(values: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    return map_points(values, lambda x: x - dx, lambda y: y - dy, inside_and_visible(width, height))


def flip_points(values: Column, width: Column, height: Column, pairs: Sequence[int] = ()) -> Column:
    """Mirror visible points to width - x, zero the others, then swap the left and right slots in *pairs*."""
    swap = dict(zip(pairs[0::2], pairs[1::2])) | dict(zip(pairs[1::2], pairs[0::2]))
    count = F.floor(F.size(values) / 3).cast("int")

    def source(slot: Column) -> Column:
        other = F.coalesce(*[F.when(slot == own, F.lit(other)) for own, other in swap.items()])
        return F.when(other < count, other).otherwise(slot)

    return map_points(
        values, lambda x: width - x, lambda y: y, inside_and_visible(width, height), source if swap else None
    )


def pad_points(values: Column, count: Column | int) -> Column:
    """Exactly *count* triples: extra ones cut, missing ones zero; a null list is all zeros."""
    count = count if isinstance(count, Column) else F.lit(count)
    have = F.coalesce(values, F.array().cast("array<double>"))
    cut = F.slice(have, 1, count * 3)
    return F.concat(cut, F.array_repeat(F.lit(0.0), count * 3 - F.size(cut)))


def visible_count(values: Column) -> Column:
    return F.size(F.filter(values, lambda v, i: (i % 3 == 2) & (v > 0)))


def solid_parts(parts: Column) -> Column:
    """Polygon parts that can enclose an area: at least three points."""
    return F.filter(parts, lambda part: F.size(part) >= 6)
