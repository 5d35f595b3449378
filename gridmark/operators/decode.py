"""From raw head outputs to detections: top-k over query x class scores, scaling, per-class thresholds, keypoints."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridmark.functions import boxes as bx
from gridmark.functions.scalars import clipped_sigmoid, log_sum_exp, score_above, sigmoid
from gridmark.schemas import RAW_QUERIES

# Queries x classes kept per image, fusion weight, largest fused score (the float below 1).
DEFAULT_SELECT = 300
TRACE_ALPHA = 0.2
LARGEST_FUSED_SCORE = 1.0 - 2.0**-24
TINY = 1e-12


def score_images(
    images: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: StructType = RAW_QUERIES
) -> DataFrame:
    """Plug in any model: *run* turns Arrow batches of image rows into raw query rows, partition by partition."""
    return images.mapInPandas(run, schema)


def explode_scores(raw: DataFrame, clipped: bool = False, background_label: int | None = None) -> DataFrame:
    """One row per query and class with its score and its flat position query * classes + class.

    A background class is removed before anything is ranked, and labels keep their original numbers.
    """
    to_score = clipped_sigmoid if clipped else sigmoid
    classes = F.size("logits")
    rows = raw.select(
        "image_id", "query_idx", "cx", "cy", "w", "h", classes.alias("_classes"), F.posexplode("logits").alias("label", "logit")
    )
    if background_label is not None:
        rows = rows.filter(F.col("label") != background_label)
    return rows.select(
        "image_id",
        "query_idx",
        F.col("label").cast("long").alias("label"),
        to_score(F.col("logit").cast("double")).alias("score"),
        (F.col("query_idx") * F.col("_classes") + F.col("label")).cast("long").alias("flat_idx"),
        "cx",
        "cy",
        "w",
        "h",
    )


def select_topk(scored: DataFrame, k: int = DEFAULT_SELECT, threshold: float | None = None) -> DataFrame:
    """The k best (query, class) pairs per image, ties by flat index; NaN ranks first.

    A threshold keeps a prefix of the score order, so it is applied before the window and only survivors are sorted.
    NaN scores take rank slots but never pass the threshold, so they stay in until after the ranking.
    """
    if threshold is not None:
        scored = scored.filter(F.isnan("score") | (F.col("score") > threshold))
    order = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "flat_idx")
    # Spark limits groups before the shuffle only for a filter on the row number itself.
    best = scored.withColumn("det_idx", F.row_number().over(order)).filter(F.col("det_idx") <= k)
    best = best.withColumn("det_idx", F.col("det_idx") - 1)
    return best if threshold is None else best.filter(~F.isnan("score"))


def place_boxes(selected: DataFrame, images: DataFrame, clamp_size: bool = True) -> DataFrame:
    """Normalised centre boxes to clamped pixel corners."""
    sized = selected.join(images.select("image_id", "width", "height"), "image_id")
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    corners = bx.cxcywh_to_xyxy(*[F.col(c).cast("double") for c in ("cx", "cy", "w", "h")], clamp_size=clamp_size)
    placed = bx.clamp_to(bx.scale(corners, width, height), width, height)
    return sized.withColumns(dict(zip(("x1", "y1", "x2", "y2"), placed))).drop("cx", "cy", "w", "h", "width", "height")


def decode(
    raw: DataFrame,
    images: DataFrame,
    threshold: float = 0.3,
    k: int = DEFAULT_SELECT,
    background_label: int | None = None,
) -> DataFrame:
    """Raw outputs to detections as exported runtimes do it: clipped sigmoid, top-k, strict threshold, pixel boxes."""
    best = select_topk(explode_scores(raw, clipped=True, background_label=background_label), k, threshold)
    return place_boxes(best, images, clamp_size=False).drop("flat_idx")


def threshold_table(names: DataFrame, by_name: dict[str, float], default: float = 0.5) -> DataFrame:
    """One threshold per label. Names the label space does not know are an error raised when the plan runs."""
    spark = names.sparkSession
    given = spark.createDataFrame(list(by_name.items()) or [("", None)], "name string, given double")
    unknown = given.filter(F.col("name") != "").join(names, "name", "left_anti").agg(F.min("name").alias("name")).scalar()
    guard = F.when(unknown.isNotNull(), F.raise_error(F.concat(F.lit("unknown class name: "), unknown)))
    table = names.join(given, "name", "left")
    return table.select("label", F.coalesce(guard.cast("double"), "given", F.lit(default)).alias("threshold"))


def apply_class_thresholds(detections: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Keep scores strictly above their class threshold; labels outside the table are dropped."""
    joined = detections.join(thresholds.select("label", "threshold"), "label")
    return joined.filter(score_above(F.col("score"), F.col("threshold"))).drop("threshold")


# --- keypoints -------------------------------------------------------------------------------------------------------


def _log_trace_term(point: Column) -> Column:
    """log of the covariance trace from a precision Cholesky (log l11, l21, log l22) in columns 4 to 6."""
    log_l11, l21, log_l22 = F.get(point, 4), F.get(point, 5), F.get(point, 6)
    first, second = log_l11 * -2.0, log_l22 * -2.0
    third = F.log(F.greatest(F.abs(l21), F.lit(TINY))) * 2.0 + first + second
    return log_sum_exp(F.array(first, second, third))


def _log_weight(point: Column) -> Column:
    return F.log(F.greatest(sigmoid(F.get(point, 2)), F.lit(TINY)))


def log_mean_trace(points: Column) -> Column:
    """Confidence-weighted mean of the covariance traces, in log space."""
    weighted = F.transform(points, lambda p: _log_trace_term(p) + _log_weight(p))
    return log_sum_exp(weighted) - log_sum_exp(F.transform(points, _log_weight))


def fuse_score(score: Column, points: Column, alpha: float = TRACE_ALPHA) -> Column:
    """Lower a score by its keypoint uncertainty: sigmoid(log s - alpha * log mean trace), kept below 1."""
    trace = F.when(F.size(points) > 0, log_mean_trace(points)).otherwise(F.lit(0.0))
    return F.least(sigmoid(F.log(score) - trace * alpha), F.lit(LARGEST_FUSED_SCORE))


def decode_keypoints(
    selected: DataFrame, raw_points: DataFrame, images: DataFrame, slot_counts: Sequence[int], alpha: float = TRACE_ALPHA
) -> DataFrame:
    """Take the predicted class slot's points of each selected query, place them in pixels and fuse the score.

    ``raw_points`` holds image_id, query_idx and ``points``, an array of slots * max(count) points with 7 numbers.
    Detections of a class without points keep their score and get an empty list.
    """
    widest = max(slot_counts)
    joined = selected.join(raw_points, ["image_id", "query_idx"]).join(
        images.select("image_id", "width", "height"), "image_id"
    )
    counts = F.array(*[F.lit(n) for n in slot_counts])
    known = F.col("label") < len(slot_counts)
    count = F.when(known, F.get(counts, F.col("label").cast("int"))).otherwise(F.lit(0))
    start = (F.col("label") * widest + 1).cast("int")
    active = F.when(count > 0, F.slice("points", start, count)).otherwise(F.slice("points", 1, 0))
    staged = joined.withColumn("_active", active)
    fused = F.when(known, fuse_score(F.col("score"), F.col("_active"), alpha)).otherwise(F.col("score"))
    placed = F.transform(
        "_active",
        lambda p: F.struct(
            (F.get(p, 0) * F.col("width")).alias("x"),
            (F.get(p, 1) * F.col("height")).alias("y"),
            sigmoid(F.get(p, 2)).alias("confidence"),
            F.get(p, 4).alias("log_l11"),
            F.get(p, 5).alias("l21"),
            F.get(p, 6).alias("log_l22"),
        ),
    )
    return staged.withColumns({"score": fused, "keypoints": placed}).drop("_active", "points", "width", "height")


def keypoint_rows(detections: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row per point with confidence >= *threshold* that is not at the origin (1e-8 on both axes)."""
    rows = detections.select("*", F.posexplode("keypoints").alias("keypoint_idx", "_point")).drop("keypoints")
    at_origin = (F.abs(F.col("_point.x")) <= 1e-8) & (F.abs(F.col("_point.y")) <= 1e-8)
    return (
        rows.filter((F.col("_point.confidence") >= threshold) & ~F.isnan("_point.confidence") & ~at_origin)
        .withColumns({"x": F.col("_point.x"), "y": F.col("_point.y"), "confidence": F.col("_point.confidence")})
        .drop("_point")
    )


def pixel_covariance(log_l11: Column, l21: Column, log_l22: Column, width: Column, height: Column) -> Column:
    """2x2 pixel covariance from a normalised precision Cholesky, null when any entry is not finite."""
    l11, l22 = F.exp(log_l11), F.exp(log_l22)
    inverse = F.try_divide(F.lit(1.0), l11 * l11 * l22 * l22)
    xx = width * width * (inverse * (l21 * l21 + l22 * l22))
    xy = width * height * (inverse * (-l11 * l21) + 0.0)
    yy = height * height * (inverse * (l11 * l11))
    limit = F.lit(float("inf"))
    finite = F.lit(True)
    for value in (log_l11, l21, log_l22, xx, xy, yy):
        finite = finite & ~F.isnan(value) & (F.abs(value) < limit)
    built = F.struct(xx.alias("xx"), xy.alias("xy"), yy.alias("yy"))
    return F.when(F.coalesce(finite, F.lit(False)), built)
