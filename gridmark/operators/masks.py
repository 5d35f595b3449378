"""Masks as disjoint runs of column-major pixel positions, in two forms.

*Run rows* (image_id, instance_id, label, run_start, run_end exclusive) make masks relational: extent, run lengths and
merging are sums and window steps. *Packed masks* are one row each: (image_id, instance_id, label, starts, ends, area, x1,
y1, x2, y2), where ``starts`` and ``ends`` list the borders of the runs in order, and the box is the tight one, in pixels of a
grid of the image's height. Pairs of packed masks meet by their boxes, and their sorted borders merge into an intersection
without a row per run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from gridmark import scale

KEYS = ["image_id", "label"]
# Height of the grid in which boxes around masks are taken when the image's own is not known. Any height gives right
# pairs as long as both sides use the same; the image's own gives the fewest candidates.
GRID_HEIGHT = 4096
# Pixels of a side of the tiles in which masks meet.
TILE = 128
_LONGS = ArrayType(LongType())


def _solid(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("run_end") > F.col("run_start"))


def pack_masks(runs: DataFrame, height: Column | None = None) -> DataFrame:
    """Run rows as packed masks; a mask without pixels has no row. *height* is a column of the runs or a literal.

    Rows may also be packed parts of masks without a pixel in common, which become one mask each.
    """
    keys = [*KEYS, "instance_id"]
    if "starts" in runs.columns:
        extent = [F.sum("area").alias("area"), *[F.min(c).alias(c) for c in ("x1", "y1")], *[F.max(c).alias(c) for c in ("x2", "y2")]]
        packed = _gathered(runs, keys, *extent)
    else:
        sized = runs.withColumn("_h", (F.lit(GRID_HEIGHT) if height is None else height).cast("bigint"))
        left, top, right, bottom = _extent()
        packed = _gathered(
            sized, keys, F.sum(F.col("run_end") - F.col("run_start")).alias("area"), F.min(left).alias("x1"), F.min(top).alias("y1"),
            (F.max(right) + 1).alias("x2"), (F.max(bottom) + 1).alias("y2"),
        )
    return packed.select(*keys, "starts", "ends", "area", "x1", "y1", "x2", "y2")


def rectangle_masks(boxes: DataFrame, height: Column) -> DataFrame:
    """Packed masks of integer rectangles x1, y1, x2, y2 (ends exclusive), without a row per column."""
    x1, y1, x2, y2 = (F.col(c).cast("bigint") for c in ("x1", "y1", "x2", "y2"))
    h = height.cast("bigint")
    starts = F.sequence(x1 * h + y1, (x2 - 1) * h + y1, h)
    ends = F.sequence(x1 * h + y2, (x2 - 1) * h + y2, h)
    return boxes.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).select(
        *KEYS, "instance_id", starts.alias("starts"), ends.alias("ends"), ((x2 - x1) * (y2 - y1)).alias("area"),
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
    )


def _packed(masks: DataFrame, height: Column | None) -> DataFrame:
    return masks if "starts" in masks.columns else pack_masks(masks, height)


def mask_areas(masks: DataFrame) -> DataFrame:
    if "starts" in masks.columns:
        return masks.select("image_id", "label", "instance_id", "area")
    return masks.groupBy("image_id", "label", "instance_id").agg(F.sum(F.col("run_end") - F.col("run_start")).alias("area"))


# A mask on its way to others: its first border, then for each run the step from the run before and the length. Steps
# that a narrow number cannot hold make the whole mask wide.
_STEPS = "struct<first:bigint,steps:array<int>,wide:array<bigint>>"


def _stepped(starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Borders of masks as steps."""
    begin, sizes = _flat(starts)
    end, _ = _flat(ends)
    offsets = np.cumsum(sizes) - sizes
    steps = np.empty(2 * len(begin), np.int64)
    steps[0::2], steps[1::2] = np.diff(begin, prepend=0), end - begin
    steps[2 * offsets[sizes > 0]] = 0
    row = np.repeat(np.arange(len(sizes)), 2 * sizes)
    far = np.bincount(row[np.abs(steps) > np.iinfo(np.int32).max], minlength=len(sizes)) > 0
    narrow = _listed(steps[~far[row]].astype(np.int32), np.where(far, 0, 2 * sizes))
    wide = _listed(steps[far[row]], np.where(far, 2 * sizes, 0))
    first = np.append(begin, 0)[offsets]
    return pa.StructArray.from_arrays([pa.array(first), narrow, wide], ["first", "steps", "wide"])


def _borders(masks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all masks one after the other, and the mask of each."""
    first, narrow, wide = masks.flatten()
    steps, sizes = _flat(narrow)
    if len(far := _flat(wide)[0]):
        far_sizes = _flat(wide)[1]
        sizes = sizes + far_sizes
        is_far = np.repeat(far_sizes > 0, sizes)
        both = np.empty(len(is_far), np.int64)
        both[is_far], both[~is_far] = far, steps
        steps = both
    runs = sizes // 2
    row = np.repeat(np.arange(len(runs)), runs)
    reached = np.cumsum(steps[0::2], dtype=np.int64)
    # The first step of a mask is 0, so what is reached there was reached by the masks before.
    before = np.append(reached, 0)[np.cumsum(runs) - runs]
    begin = reached + (pc.fill_null(first, 0).to_numpy(zero_copy_only=False) - before)[row]
    return begin, begin + steps[1::2], row


def _shared(left: pa.Array, right: pa.Array) -> pa.Array:
    """Pixels that each pair of masks shares.

    With the starts of both masks in order, and the ends in order, the i-th end lies after the next start by as many pixels
    as these two overlap: at a pixel with n open runs, n - 1 such pairs are open, and the runs of one mask are disjoint.
    """
    sides = [_borders(side) for side in (left, right)]
    starts, ends, row = (np.concatenate(parts) for parts in zip(*sides, strict=True))
    if not len(row):
        return pa.array(np.zeros(len(left), np.int64))
    low, high = int(min(starts.min(), ends.min())), int(max(starts.max(), ends.max()))
    if len(left) * (high - low + 1) < 2**62:
        # Pairs one after the other on one line, so that plain numbers are sorted.
        along = row * (high - low + 1) - low
        starts, ends, row = np.sort(starts + along), np.sort(ends + along), np.sort(row)
    else:
        starts, ends, row = starts[np.lexsort((starts, row))], ends[np.lexsort((ends, row))], np.sort(row)
    over = np.where(row[1:] == row[:-1], ends[:-1] - starts[1:], 0).clip(0)
    total = np.append(0, np.cumsum(over))
    count = np.bincount(row, minlength=len(left))
    last = np.cumsum(count)
    # A pair's overlaps stand between its borders, one less than those.
    return pa.array(np.where(count > 0, total[np.maximum(last - 1, 0)] - total[np.minimum(last - count, len(total) - 1)], 0))


def _tiled(masks: DataFrame) -> DataFrame:
    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / TILE), F.floor((F.col(high) - 1) / TILE)))

    return masks.withColumn("_tx", span("x1", "x2")).withColumn("_ty", span("y1", "y2"))


def mask_overlaps(left: DataFrame, right: DataFrame, height: Column | None = None, parts: int = 1) -> DataFrame:
    """Intersection, union and IoU of same-image same-class masks that share a pixel; other pairs have IoU 0.

    Masks meet in the tiles that their boxes touch, and a pair whose boxes touch is compared once, in the tile of the low
    corner of what the boxes share. So a crowded image does not compare all with all, and no group is probed or gathered.
    Either side may be run rows (packed here, with *height*) or packed masks. With *parts*, images are compared in so many
    parts one after the other, and the result is a stored table (see :func:`gridmark.scale.in_parts`).
    """
    return scale.in_parts(parts, "image_id", [left, right], lambda a, b: _overlaps(a, b, height), "mask-overlaps")


def _overlaps(left: DataFrame, right: DataFrame, height: Column | None) -> DataFrame:
    corners = ("x1", "y1", "x2", "y2")

    def side(masks: DataFrame, name: str) -> DataFrame:
        steps = F.arrow_udf(_stepped, _STEPS)("starts", "ends").alias("_mask")
        stepped = _packed(masks, height).select(*KEYS, F.col("instance_id").alias(f"{name}_id"), F.col("area").alias(f"{name}_area"), *corners, steps)
        return _tiled(stepped)

    a = side(left, "left")
    b = side(right, "right").withColumnsRenamed({c: f"_{c}" for c in corners} | {"_mask": "_other"})
    # Masks are often larger than the estimate of their side; it is not to be broadcast.
    b = b.hint("merge")
    x, y = F.greatest("x1", "_x1"), F.greatest("y1", "_y1")
    touching = (x < F.least("x2", "_x2")) & (y < F.least("y2", "_y2"))
    own_tile = (F.floor(x / TILE) == F.col("_tx")) & (F.floor(y / TILE) == F.col("_ty"))
    met = a.join(b, [*KEYS, "_tx", "_ty"]).filter(touching & own_tile)
    # Generated instead of projected, so that a filter on it does not evaluate it twice.
    names = [*KEYS, "left_id", "right_id", "left_area", "right_area"]
    intersection = F.explode(F.array(F.arrow_udf(_shared, LongType())("_mask", "_other"))).alias("intersection")
    shared = met.select(*names, intersection).filter("intersection > 0")
    union = F.col("left_area") + F.col("right_area") - F.col("intersection")
    return shared.withColumn("union", union).withColumn("iou", F.col("intersection").cast("double") / F.col("union"))


def matching_pairs(
    detections: DataFrame, truth: DataFrame, crowds: DataFrame | None = None, height: Column | None = None, parts: int = 1
) -> DataFrame:
    """Mask overlaps in the form the matching operators take: IoU, or for *crowds* the share of the detection covered.

    *crowds* are the ground truths under the published protocol's crowd rule; the confidence sweep has none.
    """
    overlaps = mask_overlaps(detections, truth, height, parts).withColumnRenamed("right_id", "gt_idx")
    overlap = F.col("iou")
    if crowds is not None:
        overlaps = overlaps.join(crowds.select(*KEYS, "gt_idx", F.lit(True).alias("_crowd")), [*KEYS, "gt_idx"], "left")
        overlap = F.when(F.col("_crowd"), F.col("intersection").cast("double") / F.col("left_area")).otherwise(overlap)
    return overlaps.select(*KEYS, F.col("left_id").alias("det_idx"), "gt_idx", overlap.alias("overlap"))


def _extent() -> tuple[Column, Column, Column, Column]:
    """First and last column and row of a run in a grid of height ``_h``."""
    first, last = F.col("run_start"), F.col("run_end") - 1
    left, right = F.floor(first / F.col("_h")), F.floor(last / F.col("_h"))
    # A run over several columns passes through row 0 and the last row.
    spans = right > left
    top = F.when(spans, F.lit(0)).otherwise(first % F.col("_h"))
    bottom = F.when(spans, F.col("_h") - 1).otherwise(last % F.col("_h"))
    return left, top, right, bottom


def tight_boxes(runs: DataFrame, height: Column, exclusive_end: bool) -> DataFrame:
    """Smallest box around each mask. The far edge is the last pixel, or one past it with *exclusive_end*."""
    sized = _solid(runs).withColumn("_h", height)
    left, top, right, bottom = _extent()
    add = 1 if exclusive_end else 0
    return sized.groupBy(*KEYS, "instance_id").agg(
        F.min(left).cast("double").alias("x1"),
        F.min(top).cast("double").alias("y1"),
        (F.max(right) + add).cast("double").alias("x2"),
        (F.max(bottom) + add).cast("double").alias("y2"),
    )


def sync_boxes(instances: DataFrame, before: DataFrame, after: DataFrame, height: Column) -> DataFrame:
    """Boxes follow their transformed masks: drop an instance whose mask became empty, keep box-only instances."""
    keys = [*KEYS, "instance_id"]
    had = before.filter(F.col("run_end") > F.col("run_start")).select(*keys).distinct().withColumn("_had", F.lit(True))
    boxes = tight_boxes(after, height, exclusive_end=True).select(
        *keys, *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")]
    )
    joined = instances.join(had, keys, "left").join(boxes, keys, "left")
    follow = F.col("_had").isNotNull() & F.col("_x1").isNotNull()
    kept = joined.filter(F.col("_had").isNull() | F.col("_x1").isNotNull())
    changed = {c: F.when(follow, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("x1", "y1", "x2", "y2")}
    return kept.withColumns(changed).drop("_had", "_x1", "_y1", "_x2", "_y2")


def _gathered(spans: DataFrame, keys: list[str], *extent: Column) -> DataFrame:
    """Sorted starts and ends of all spans of a key, from run rows or from rows of several spans."""
    if "starts" in spans.columns:
        borders = [F.sort_array(F.flatten(F.collect_list(name))).alias(name) for name in ("starts", "ends")]
        return spans.groupBy(*keys).agg(*borders, *extent)
    borders = [F.sort_array(F.collect_list(f"run_{name}")).alias(f"{name}s") for name in ("start", "end")]
    return _solid(spans).groupBy(*keys).agg(*borders, *extent)


def _inline_runs(packed: DataFrame, *names: str) -> DataFrame:
    """Run rows of sorted borders."""
    return packed.select(*names, F.inline(F.arrays_zip("starts", "ends")).alias("run_start", "run_end"))


def merge_runs(spans: DataFrame) -> DataFrame:
    """Touching or overlapping spans of an instance become one run (gaps and islands)."""
    keys = [*KEYS, "instance_id"]
    order = Window.partitionBy(*keys).orderBy("run_start", "run_end")
    reached = F.max("run_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.filter(F.col("run_end") > F.col("run_start")).withColumn(
        "_new", F.when(reached.isNull() | (F.col("run_start") > reached), 1).otherwise(0)
    )
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end")).drop(
        "_island"
    )


def run_lengths(spans: DataFrame, pixels: Column, listed: bool = False) -> DataFrame:
    """Alternating background and foreground run lengths per instance, starting with background (possibly 0).

    *pixels* is the mask size. The trailing background run is part of the list, but not when its length is 0. *spans* are
    run rows or packed masks, whose lists never leave their row. With *listed*, one row per instance with ``counts``
    instead of a row per length. Instances with a null in their key have none.
    """
    keys = [*KEYS, "instance_id"]
    known = spans.dropna(subset=keys).withColumn("_pixels", pixels.cast("long"))
    if "starts" not in spans.columns:
        known = _gathered(known, [*keys, "_pixels"])
    counts = known.select(*keys, F.arrow_udf(_lengths, _LONGS)("starts", "ends", "_pixels").alias("counts"))
    return counts if listed else counts.select(*keys, F.posexplode("counts").alias("position", "length"))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists one after the other, and the length of each list; nulls inside lists count as 0."""
    values = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
    return values, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _listed(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _lengths(starts: pa.Array, ends: pa.Array, pixels: pa.Array) -> pa.Array:
    """Run lengths of masks from their sorted borders. Runs that touch or overlap become one."""
    begin, sizes = _flat(starts)
    end, _ = _flat(ends)
    row = np.repeat(np.arange(len(sizes)), sizes)
    # The first border of a mask, and those with a gap before them, begin a run; what lies before a beginning ends one.
    new = np.ones(len(begin), bool)
    new[1:] = (row[1:] != row[:-1]) | (begin[1:] > end[:-1])
    last = np.append(new[1:], True)[: len(new)]
    begin, end, row = begin[new], end[last], row[new]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    before = np.where(first, 0, np.concatenate([[0], end[:-1]])[: len(end)])
    total = pc.fill_null(pixels, 0).to_numpy(zero_copy_only=False)
    runs = np.bincount(row, minlength=len(sizes))
    tail = np.zeros(len(sizes), np.int64)
    final = np.append(first[1:], True)[: len(first)]
    tail[row[final]] = np.maximum(total[row[final]] - end[final], 0)
    count = 2 * runs + (tail > 0)
    values = np.zeros(int(count.sum()), np.int64)
    # Every run stands after two entries for each run before it, and one for each trailing background before it.
    place = 2 * np.arange(len(row)) + (np.cumsum(tail > 0) - (tail > 0))[row]
    values[place], values[place + 1] = begin - before, end - begin
    values[(np.cumsum(count) - 1)[tail > 0]] = tail[tail > 0]
    return _listed(values, count)


def _running(counts: pa.Array) -> pa.Array:
    """Running sums of each list."""
    values, sizes = _flat(counts)
    sums = np.concatenate([[0], np.cumsum(values)])
    starts = np.cumsum(sizes) - sizes
    return _listed(sums[1:] - np.repeat(sums[starts], sizes), sizes)


def counted_runs(instances: DataFrame) -> DataFrame:
    """Run rows of instances with ``counts``, the inverse of :func:`run_lengths`: odd entries are foreground.

    Empty runs are left out. Runs that an empty background separates stay apart; :func:`merge_runs` joins them.
    """
    keys = [*KEYS, "instance_id"]
    ends = instances.select(*keys, "counts", F.arrow_udf(_running, _LONGS)("counts").alias("_ends"))
    entries = F.arrays_zip(F.col("counts").alias("_length"), F.col("_ends").alias("run_end"))
    steps = ends.select(*keys, F.posexplode(entries).alias("_n", "_e")).filter((F.col("_n") % 2 == 1) & (F.col("_e._length") > 0))
    return steps.select(*keys, (F.col("_e.run_end") - F.col("_e._length")).alias("run_start"), F.col("_e.run_end").alias("run_end"))


def read_run_lengths(instances: DataFrame) -> DataFrame:
    """Instances with ``segmentation`` (JSON text) that is a list of run lengths: ``counts``, ``height``, ``width``, ``reason``.

    ``reason`` is null for lists that fill the size exactly. Text counts are a codec's output, which is not decoded here.
    """
    # Generated instead of projected, so that a filter on what is read does not read the text again.
    texts = instances.filter(F.trim("segmentation").startswith("{"))
    parsed = texts.select(
        *instances.columns, F.inline(F.array(F.from_json("segmentation", "counts string, size array<int>"))).alias("_text", "_size")
    )
    sized = parsed.select(
        *instances.columns, F.explode(F.array(F.from_json("_text", "array<bigint>"))).alias("counts"),
        F.get("_size", 0).alias("height"), F.get("_size", 1).alias("width"), "_text",
    )
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n)
    known = F.col("counts").isNotNull() & ~F.exists("counts", lambda n: n.isNull())
    reason = (
        F.when(F.col("_text").isNull(), F.lit("no counts"))
        .when(~known, F.lit("counts are no list of whole numbers"))
        .when(F.col("height").isNull() | F.col("width").isNull() | (F.col("height") < 0) | (F.col("width") < 0), F.lit("no size"))
        .when(F.exists("counts", lambda n: n < 0), F.lit("negative count"))
        .when(total != F.col("height").cast("bigint") * F.col("width"), F.lit("counts do not fill the size"))
    )
    return sized.select(*instances.columns, "counts", "height", "width", F.explode(F.array(reason)).alias("reason"))


def rectangle_runs(boxes: DataFrame, height: Column, packed: bool = False) -> DataFrame:
    """Runs of integer rectangles x1, y1, x2, y2 (ends exclusive): one per column, or *packed* as one row per rectangle."""
    if packed:
        return rectangle_masks(boxes, height)
    return _inline_runs(rectangle_masks(boxes, height), *KEYS, "instance_id")


# Columns of polygons that are filled at a time.
FILL_COLUMNS = 500_000
_FILL = "struct<starts:array<bigint>,ends:array<bigint>>"


def polygon_runs(instances: DataFrame) -> DataFrame:
    """Runs of instances with ``polygons`` (array of flat polygons), ``width`` and ``height``; parts are merged.

    Scan-line fill, column by column: pixels whose centres lie inside by the even-odd rule. Polygons of an instance meet
    before they are filled, so that only they are shuffled and runs never leave the row of their instance.
    """
    keys = [*KEYS, "instance_id"]
    xs = F.filter("_p", lambda v, i: i % 2 == 0)
    low = F.greatest(F.lit(0), F.array_min(xs).cast("int") - 1)
    high = F.least(F.col("width"), F.array_max(xs).cast("int") + 2)
    parts = instances.select(*keys, "width", "height", F.explode("polygons").alias("_p")).filter(F.size("_p") >= 6)
    parts = parts.withColumns({"_low": low, "_high": high}).filter("_high > _low")
    part = F.struct(F.col("_p").cast("array<double>").alias("points"), "_low", "_high", F.col("height").cast("long").alias("height"))
    gathered = parts.groupBy(*keys).agg(F.collect_list(part).alias("_parts"))
    filled = gathered.select(*keys, F.explode(F.array(F.arrow_udf(_filled, _FILL)("_parts"))).alias("_runs"))
    return _inline_runs(filled.select(*keys, "_runs.*"), *keys)


def _filled(instances: pa.Array) -> pa.Array:
    """Sorted borders of the merged runs of each instance, a list of polygons with their columns and height."""
    parts = instances.flatten()
    sizes = pc.list_value_length(instances).to_numpy(zero_copy_only=False)
    wide = pc.subtract(parts.field("_high"), parts.field("_low")).to_numpy(zero_copy_only=False).astype(np.int64)
    # So many instances at a time that they have a bounded number of columns, as long as each has.
    done = np.concatenate([[0], np.cumsum(wide)])[np.cumsum(sizes)]
    cuts = np.flatnonzero(np.diff(done // FILL_COLUMNS)) + 1
    bounds = [0, *cuts.tolist(), len(instances)]
    return pa.concat_arrays([_filled_together(instances[i:j]) for i, j in zip(bounds, bounds[1:])])


def _filled_together(instances: pa.Array) -> pa.Array:
    parts = instances.flatten()
    owner = np.repeat(np.arange(len(instances)), pc.list_value_length(instances).to_numpy(zero_copy_only=False))
    points, low, high, height = parts.flatten()
    heights = pc.fill_null(height, 0).to_numpy(zero_copy_only=False)
    low, high = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (low, high))
    column, y, absent = _crossings(points, low, high)
    # Columns of all polygons one after the other; the crossings of each in order, missing heights last.
    wide = high - low
    before = np.cumsum(wide) - wide
    order = np.lexsort((y, absent, column) if absent.any() else (y, column))
    column, y, absent = column[order], y[order], absent[order]
    first = np.flatnonzero(np.append(True, column[1:] != column[:-1])[: len(column)])
    count = np.diff(np.append(first, len(column)))
    opening = np.zeros(len(column), bool)
    opening[(np.arange(len(column)) - np.repeat(first, count)) % 2 == 0] = True
    opening &= np.append(column[1:] == column[:-1], False)[: len(column)]
    begin = np.flatnonzero(opening)
    part = np.searchsorted(before, column[begin], "right") - 1
    tall = heights[part]
    # A run begins at the first pixel whose centre is not above the crossing.
    top = np.where(absent[begin], 0, _first_centre(y[begin]).clip(0))
    bottom = np.where(absent[begin + 1], tall, np.minimum(_first_centre(y[begin + 1]), tall))
    kept = bottom > top
    base = ((column[begin] - before[part] + low[part]) * tall)[kept]
    return _merged(owner[part[kept]], base + top[kept], base + bottom[kept], len(instances))


def _first_centre(y: np.ndarray) -> np.ndarray:
    """The first whole number whose half step further is not below *y*; 0 for NaN."""
    return np.nan_to_num(np.ceil(y - 0.5), nan=0.0).clip(-(2.0**62), 2.0**62).astype(np.int64)


def _crossings(points: pa.ListArray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where edges cross the centres of their polygon's columns: the column among all polygons', height, no height known."""
    flat = points.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    values = flat.to_numpy(zero_copy_only=False)
    size = pc.list_value_length(points).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    edges = size // 2
    polygon = np.repeat(np.arange(len(size)), edges)
    i = np.arange(len(polygon)) - np.repeat(np.cumsum(edges) - edges, edges)
    x1, y1, x2, y2 = (start[polygon] + (2 * i + k) % size[polygon] for k in range(4))
    usable = known[x1] & known[x2]
    polygon, x1, y1, x2, y2 = (a[usable] for a in (polygon, x1, y1, x2, y2))
    has_y = known[y1] & known[y2]
    x1, y1, x2, y2 = (values[a] for a in (x1, y1, x2, y2))

    def column_from(x: np.ndarray) -> np.ndarray:
        """The first column of the polygon whose centre is at or past x, its end for NaN."""
        return np.clip(np.ceil(np.nan_to_num(x, nan=np.inf) - 0.5), low[polygon], high[polygon]).astype(np.int64)

    ends = column_from(x1), column_from(x2)
    left = np.minimum(*ends)
    crossed = np.maximum(*ends) - left
    edge = np.repeat(np.arange(len(polygon)), crossed)
    x = left[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(crossed) - crossed, crossed)
    with np.errstate(all="ignore"):
        y = y1[edge] + (x + 0.5 - x1[edge]) * (y2[edge] - y1[edge]) / (x2[edge] - x1[edge])
    before = np.cumsum(high - low) - (high - low)
    return before[polygon[edge]] + x - low[polygon[edge]], y, ~has_y[edge]


def _merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray, owners: int) -> pa.Array:
    """Sorted borders of each owner's runs; runs that touch or overlap become one."""
    order = np.lexsort((end, start, owner))
    owner, start, end = owner[order], start[order], end[order]
    # Ends by their place among all ends, so that the running largest end of an owner starts above those before it.
    ranked = np.sort(end)
    reached = np.maximum.accumulate(owner * len(end) + np.searchsorted(ranked, end)) - owner * len(end)
    reached = ranked[reached] if len(end) else end
    new = np.ones(len(end), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > reached[:-1])
    last = np.append(new[1:], True)[: len(new)]
    sizes = np.bincount(owner[new], minlength=owners)
    return pa.StructArray.from_arrays([_listed(start[new], sizes), _listed(reached[last], sizes)], ["starts", "ends"])
