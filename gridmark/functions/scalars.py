"""Scalar helpers whose exact null, NaN and boundary rules matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: logits are limited to this magnitude before the exponential when decoding exported heads.
LOGIT_LIMIT = 88.0


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clipped_sigmoid(x: Column) -> Column:
    limited = F.least(F.greatest(x, F.lit(-LOGIT_LIMIT)), F.lit(LOGIT_LIMIT))
    return F.when(F.isnan(x), x).otherwise(sigmoid(limited))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow; equals minus the log-sigmoid of -x."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def focal_cost(logit: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Focal classification cost of assigning a query to a class, from its logit."""
    p = sigmoid(logit)
    positive = F.lit(alpha) * F.pow(F.lit(1.0) - p, F.lit(gamma)) * softplus(-logit)
    negative = F.lit(1 - alpha) * F.pow(p, F.lit(gamma)) * softplus(logit)
    return positive - negative


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as DOUBLE, 0 for an empty denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def score_above(score: Column, threshold) -> Column:
    """Strictly above, the prediction rule; NaN never passes."""
    return (score > threshold) & ~F.isnan(score)


def score_at_least(score: Column, threshold) -> Column:
    """At or above, the sweep rule; NaN never passes."""
    return (score >= threshold) & ~F.isnan(score)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def log_sum_exp(values: Column) -> Column:
    """log of the sum of exp over an array column, shifted by its maximum."""
    peak = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - peak))
    return peak + F.log(total)


def grid_position(value: Column, grid: Sequence[float]) -> Column:
    """How many entries of the ascending *grid* are <= value, as a balanced decision tree of comparisons."""

    def descend(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(float(grid[middle])), descend(middle + 1, high)).otherwise(descend(low, middle))

    return descend(0, len(grid))


def literal_array(values: Sequence, kind: str = "double") -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def latest_completed_week(today: Column) -> tuple[Column, Column]:
    """Monday and Sunday of the last Monday-to-Sunday week that ended before *today*."""
    monday = F.trunc(today, "week")
    return F.date_sub(monday, 7), F.date_sub(monday, 1)
