"""Confidence sweeps and threshold tuning over matched detections.

Scores are binned into the threshold grid once, so a sweep costs one pass over the detections plus classes x grid
rows; detections are never multiplied by thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.functions.scalars import grid_position, ratio_or_zero, score_above

# 101 evenly spaced thresholds, each position times the step.
DEFAULT_GRID = tuple(i * 0.01 for i in range(100)) + (1.0,)
MIN_TUNING_OBJECTS = 5


def score_bins(matched: DataFrame, grid: Sequence[float] = DEFAULT_GRID) -> DataFrame:
    """TP and FP per class and bin; ``bin`` is the number of grid thresholds the score reaches, 0 being none.

    The counts of different batches simply add up, which is what makes the sweep mergeable and streamable.
    """
    score = F.col("score").cast("double")
    counted = matched.filter(~F.col("is_ignored") & ~F.isnan(score)).select(
        "label", grid_position(score, sorted(grid)).alias("bin"), "is_tp"
    )
    return counted.groupBy("label", "bin").agg(
        F.count_if("is_tp").alias("tp"), F.count_if(~F.col("is_tp")).alias("fp")
    )


def counts_at_thresholds(
    bins: DataFrame, gt_counts: DataFrame, grid: Sequence[float] = DEFAULT_GRID
) -> DataFrame:
    """TP and FP of every class at every threshold (score >= threshold), classes without detections included.

    Works on classes x grid rows: the window below is per class and never longer than the grid.
    """
    ordered = sorted(grid)
    frame = gt_counts.select(
        "label",
        "total_gt",
        F.posexplode(F.array(*[F.lit(float(t)) for t in ordered])).alias("_position", "threshold"),
    ).withColumn("bin", F.col("_position") + 1)
    down = Window.partitionBy("label").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = frame.join(bins.filter(F.col("bin") > 0), ["label", "bin"], "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "label",
        "threshold",
        "total_gt",
        F.coalesce(F.sum("tp").over(down), zero).alias("tp"),
        F.coalesce(F.sum("fp").over(down), zero).alias("fp"),
    )


def with_scores(counts: DataFrame) -> DataFrame:
    """Add precision, recall and F1; empty denominators give 0."""
    precision = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio_or_zero(F.col("tp"), F.col("total_gt"))
    scored = counts.withColumns({"precision": precision, "recall": recall})
    product = F.col("precision") * 2.0 * F.col("recall")
    return scored.withColumn("f1", ratio_or_zero(product, F.col("precision") + F.col("recall")))


def sweep_by_class(matched: DataFrame, gt_counts: DataFrame, grid: Sequence[float] = DEFAULT_GRID) -> DataFrame:
    return with_scores(counts_at_thresholds(score_bins(matched, grid), gt_counts, grid))


def macro_sweep(by_class: DataFrame) -> DataFrame:
    """Unweighted means over the classes with ground truth; 0 when there are none."""
    real = F.col("total_gt") > 0

    def mean(name: str) -> Column:
        return F.coalesce(F.avg(F.when(real, F.col(name))), F.lit(0.0)).alias(f"macro_{name}")

    return by_class.groupBy("threshold").agg(mean("f1"), mean("precision"), mean("recall"))


def best_threshold(macro: DataFrame, digits: int | None = None) -> DataFrame:
    """The first threshold with the largest macro F1, compared as it is, or rounded to *digits*.

    A mean over classes may differ in its last bit with the order of its terms; *digits* makes such values tie.
    """
    f1 = F.col("macro_f1") if digits is None else F.round("macro_f1", digits)
    return macro.orderBy(f1.desc(), "threshold").limit(1)


def class_scores_at_best(by_class: DataFrame, digits: int | None = None) -> DataFrame:
    chosen = best_threshold(macro_sweep(by_class), digits).select("threshold")
    return by_class.join(chosen, "threshold")


def tune_class_thresholds(
    by_class: DataFrame, minimum_objects: int = MIN_TUNING_OBJECTS, digits: int | None = None
) -> DataFrame:
    """Each class's first F1-best threshold, or the best single one for rare classes and classes with F1 0 everywhere."""
    single = best_threshold(macro_sweep(by_class), digits).select("threshold").scalar()
    order = Window.partitionBy("label").orderBy(F.col("f1").desc(), "threshold")
    own = by_class.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1)
    has_own = (F.col("total_gt") >= minimum_objects) & (F.col("f1") > 0)
    return own.select(
        "label", F.when(has_own, F.col("threshold")).otherwise(single).alias("threshold"), has_own.alias("has_own")
    )


def recall_target_threshold(by_class: DataFrame, target: float) -> DataFrame:
    """Highest threshold at which a class still reaches *target* recall; null when it never does."""
    return by_class.groupBy("label").agg(
        F.max(F.when(F.col("recall") >= target, F.col("threshold"))).alias("threshold")
    )


def strict_sweep_by_class(matched: DataFrame, gt_counts: DataFrame, grid: Sequence[float] = DEFAULT_GRID) -> DataFrame:
    """The sweep under the prediction rule: a detection counts when its score is strictly above the threshold."""
    ordered = sorted(grid)
    score = F.col("score").cast("double")
    # The number of thresholds strictly below a score equals the number >= its negation on the negated grid.
    below = F.lit(len(ordered)) - grid_position(-score, [-t for t in reversed(ordered)])
    counted = matched.filter(~F.col("is_ignored") & ~F.isnan(score)).select("label", below.alias("bin"), "is_tp")
    bins = counted.groupBy("label", "bin").agg(
        F.count_if("is_tp").alias("tp"), F.count_if(~F.col("is_tp")).alias("fp")
    )
    return with_scores(counts_at_thresholds(bins, gt_counts, ordered))


def score_thresholds(matched: DataFrame, gt_counts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Judge a threshold choice on held-out detections: macro F1, pooled precision and recall, kept count."""
    kept = matched.filter(~F.col("is_ignored")).join(thresholds.select("label", "threshold"), "label")
    kept = kept.filter(score_above(F.col("score").cast("double"), F.col("threshold")))
    counts = kept.groupBy("label").agg(F.count_if("is_tp").alias("tp"), F.count_if(~F.col("is_tp")).alias("fp"))
    zero = F.lit(0).cast("long")
    rows = gt_counts.join(counts, "label", "left").select(
        "label", "total_gt", F.coalesce("tp", zero).alias("tp"), F.coalesce("fp", zero).alias("fp")
    )
    f1 = ratio_or_zero(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("total_gt") - F.col("tp"))
    return rows.agg(
        F.avg(F.when(F.col("total_gt") > 0, f1)).alias("macro_f1"),
        ratio_or_zero(F.sum("tp"), F.sum("tp") + F.sum("fp")).alias("precision"),
        ratio_or_zero(F.sum("tp"), F.sum("total_gt")).alias("recall"),
        F.sum(F.col("tp") + F.col("fp")).alias("kept"),
    )
