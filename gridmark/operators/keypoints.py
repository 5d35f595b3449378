"""Object keypoint similarity and its per-category inputs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark import scale
from gridmark.functions import points as pt
from gridmark.operators import average_precision as ap
from gridmark.operators import matching
from gridmark.operators.annotations import fill_num_keypoints

# The published per-joint constants of the 17-point person layout, in natural order.
PERSON_SIGMAS = tuple(
    s / 10.0
    for s in (
        0.26, 0.25, 0.25, 0.35, 0.35, 0.79, 0.79, 0.72, 0.72, 0.62, 0.62, 1.07, 1.07, 0.87, 0.87, 0.89, 0.89,
    )
)
# Fixed value: sigma of every joint of other layouts, at single precision.
CUSTOM_SIGMA = float(np.float32(0.05))
# Fixed value: machine epsilon added to areas and distances by the published formula.
SPACING = 2.0**-52
KEYPOINT_AREAS = ("all", "medium", "large")


def keypoint_counts(categories: DataFrame, annotations: DataFrame) -> DataFrame:
    """Points per category: the larger of the declared names and the longest vector / 3."""
    declared = categories.select("category_id", F.coalesce(F.size("keypoints"), F.lit(0)).alias("k"))
    seen = annotations.filter(F.size("keypoints") > 0).select(
        "category_id", F.floor(F.size("keypoints") / 3).cast("int").alias("k")
    )
    counts = declared.unionAll(seen).groupBy("category_id").agg(F.max("k").alias("k"))
    return counts.filter(F.col("k") > 0)


def sigma_column(k: Column, sigmas: Sequence[float] | None = None) -> Column:
    """Sigmas of a category with k points: the given ones cut to k, the person layout at 17, else the custom value."""
    if sigmas is not None:
        if not all(0 < s < float("inf") for s in sigmas):
            raise ValueError("sigmas must be positive finite numbers")
        return F.slice(F.array(*[F.lit(float(s)) for s in sigmas]), F.lit(1), k.cast("int"))
    person = F.array(*[F.lit(s) for s in PERSON_SIGMAS])
    return F.when(k == len(PERSON_SIGMAS), person).otherwise(F.array_repeat(F.lit(CUSTOM_SIGMA), k.cast("int")))


# Points of a ground truth that count: where in a detection's list, the range that is at no distance, and the variance. The
# labelled ones count, each a range of one coordinate; when none is labelled all count, with the box extended by its own
# size on every side as their range.
_COUNTED = """
transform(
  filter(sequence(0, size(_sigmas) - 1), i -> _labelled = 0 OR get(keypoints, 3 * i + 2) > 0),
  i -> named_struct(
    'at_x', 3 * i, 'at_y', 3 * i + 1,
    'low_x', CASE WHEN _labelled > 0 THEN get(keypoints, 3 * i) ELSE x1 - (x2 - x1) END,
    'high_x', CASE WHEN _labelled > 0 THEN get(keypoints, 3 * i) ELSE x1 + 2D * (x2 - x1) END,
    'low_y', CASE WHEN _labelled > 0 THEN get(keypoints, 3 * i + 1) ELSE y1 - (y2 - y1) END,
    'high_y', CASE WHEN _labelled > 0 THEN get(keypoints, 3 * i + 1) ELSE y1 + 2D * (y2 - y1) END,
    'variance', (2D * _sigmas[i]) * (2D * _sigmas[i])))
"""
# ``g`` is what :func:`truth_points` made of a ground truth, ``found`` the detection's points.
_SQUARE = "pow(get({found}, p.at_{axis}) - least(greatest(get({found}, p.at_{axis}), p.low_{axis}), p.high_{axis}), 2D)"
_SIMILARITY = """
CASE WHEN size({g}.points) = 0 THEN 0D ELSE aggregate(
  {g}.points, 0D, (total, p) -> total + exp(-(({x} + {y}) / p.variance / {g}.size / 2D))
) / size({g}.points) END
"""


def _similarity(g: str, found: str) -> str:
    return _SIMILARITY.format(g=g, x=_SQUARE.format(found=found, axis="x"), y=_SQUARE.format(found=found, axis="y"))


def truth_points(ground_truth: DataFrame, counts: DataFrame, sigmas: Sequence[float] | None = None) -> DataFrame:
    """Ground truths of known categories with a struct ``points_of``: everything a similarity takes from their side."""
    # One row per category. Broadcast, for a shuffle by category puts all ground truths into as many tasks as there are
    # categories, and whatever is grouped by image and category afterwards stays there.
    known = F.broadcast(counts.select(F.col("category_id").alias("label"), "k"))
    truth = ground_truth.join(known, "label").withColumn("_sigmas", sigma_column(F.col("k"), sigmas))
    truth = truth.withColumn(
        "_labelled", F.expr("size(filter(slice(keypoints, 1, 3 * k), (v, i) -> i % 3 = 2 AND v > 0))")
    )
    facts = f"named_struct('size', area + {SPACING!r}D, 'points', {_COUNTED})"
    return truth.withColumn("points_of", F.expr(facts)).drop("_sigmas", "_labelled", "k")


def similarity_pairs(
    detections: DataFrame, ground_truth: DataFrame, counts: DataFrame, sigmas: Sequence[float] | None = None
) -> DataFrame:
    """Similarity of all detections and ground truths of the same image and category.

    With labelled points it is their mean of exp(-squared distance / (2 * (2 sigma)^2 * area)). Everything that only
    depends on the ground truth is computed before the join.
    """
    truth = truth_points(ground_truth, counts, sigmas).select(*matching.GROUP, "gt_idx", "points_of")
    return _joined_similarity(detections, truth).select(*matching.GROUP, "det_idx", "gt_idx", "overlap")


def _joined_similarity(detections: DataFrame, truth: DataFrame) -> DataFrame:
    found = detections.select(*matching.GROUP, "det_idx", F.col("keypoints").alias("_found"))
    # Generated instead of projected, so that a filter on it does not evaluate it twice.
    value = F.explode(F.array(F.expr(_similarity("points_of", "_found")))).alias("overlap")
    joined = found.join(truth, matching.GROUP)
    return joined.select(*matching.GROUP, "det_idx", *[c for c in truth.columns if c not in matching.GROUP], value)


def keypoint_overlap(lanes: matching.Lanes) -> matching.Overlap:
    """Similarity inside the fold, for detections with ``keypoints`` and ground truths with ``points_of``.

    The protocol caps detections at 20 per image and category, so a ground truth of a large group has at most 20 pairs.
    """
    low = min(lanes.thresholds)
    near = (
        f"filter(transform(gts, (g, i) -> named_struct('overlap', {_similarity('g.points_of', 'd.keypoints')}, 'pos', i + 1, "
        f"'regular', g.regular, 'crowd', g.crowd)), o -> o.overlap >= {low!r}D)"
    )

    def pairs(detections: DataFrame, truth: DataFrame) -> DataFrame:
        found = _joined_similarity(detections, truth).drop("points_of")
        return found.filter(F.col("overlap") >= low)

    return matching.Overlap(near, pairs, ("keypoints",), ("points_of",))


def point_box(keypoints: Column) -> list[Column]:
    """Box around the listed points, which stands in for a missing detection box."""
    xs = F.filter(keypoints, lambda v, i: i % 3 == 0)
    ys = F.filter(keypoints, lambda v, i: i % 3 == 1)
    return [
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"),
    ]


def evaluate_keypoints(
    detections: DataFrame,
    ground_truth: DataFrame,
    counts: DataFrame,
    sigmas: Sequence[float] | None = None,
    group_row_limit: int = scale.GROUP_ROW_LIMIT,
) -> ap.Evaluation:
    """Keypoint evaluation. Categories with different point counts run in one plan with their own sigmas.

    Ground truths without labelled points are ignored, like crowds. Detection areas come from the points' extent.
    """
    cap = ap.KEYPOINT_MAX_DETS[-1]
    # One row per category, used by both sides; what it is counted from should be read once.
    counts = scale.stored(counts, "keypoint-counts")
    known = F.broadcast(counts.select(F.col("category_id").alias("label")))
    truth = truth_points(ap.truth_areas(fill_num_keypoints(ground_truth)), counts, sigmas)
    truth = truth.withColumn("_no_points", F.coalesce("num_keypoints", F.lit(0)) == 0)
    # An unlabelled ground truth may absorb one detection only, unlike a crowd, so it is put outside every area range.
    truth = truth.withColumn("area", F.when(F.col("_no_points"), F.lit(-1.0)).otherwise(F.col("area")))
    found = detections.join(known, "label", "left_semi")
    if "x1" not in found.columns:
        found = found.select("*", *point_box(F.col("keypoints")))
    lanes = matching.coco_lanes(ap.IOU_GRID, KEYPOINT_AREAS)
    scored = matching.match_lanes(found, truth, lanes, None, cap, group_row_limit, keypoint_overlap(lanes))
    return ap.accumulate(scored, ap.truth_counts(truth, lanes), lanes, ap.KEYPOINT_MAX_DETS)


def visible_points(keypoints: Column) -> Column:
    return pt.visible_count(keypoints)
