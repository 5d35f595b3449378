"""Tables that compare raw head outputs with targets or with another run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.functions import boxes as bx
from gridmark.functions.scalars import focal_cost, is_finite, sigmoid

# Fixed value: distance of the replacement for non-finite costs from the largest valid cost.
COST_MARGIN = 1.0


def assignment_costs(
    raw: DataFrame,
    targets: DataFrame,
    class_weight: float = 2.0,
    box_weight: float = 5.0,
    giou_weight: float = 2.0,
    alpha: float = 0.25,
) -> DataFrame:
    """Cost of assigning each query to each target of its own image: focal class cost, L1 and negated GIoU.

    ``targets`` holds image_id, target_idx, label and a normalised centre box. A head emits a fixed number of queries
    per image, so the table grows with the targets.
    """
    right = targets.select(
        "image_id", "target_idx", F.col("label").alias("_label"), *[F.col(c).alias(f"t_{c}") for c in ("cx", "cy", "w", "h")]
    )
    joined = raw.join(right, "image_id")
    query = [F.col(c).cast("double") for c in ("cx", "cy", "w", "h")]
    target = [F.col(f"t_{c}").cast("double") for c in ("cx", "cy", "w", "h")]
    logit = F.get("logits", F.col("_label").cast("int")).cast("double")
    giou = bx.giou(bx.cxcywh_to_xyxy(*query), bx.cxcywh_to_xyxy(*target))
    parts = joined.select(
        "image_id",
        "query_idx",
        "target_idx",
        focal_cost(logit, alpha).alias("class_cost"),
        bx.l1_distance(query, target).alias("box_cost"),
        (-giou).alias("giou_cost"),
    )
    total = F.col("box_cost") * box_weight + F.col("class_cost") * class_weight + F.col("giou_cost") * giou_weight
    return parts.withColumn("cost", total)


def replace_non_finite(costs: DataFrame, cost: str = "cost") -> DataFrame:
    """Non-finite costs become a value above every valid one: max + max|.| + 1 over the table, as a one-value subquery."""
    valid = costs.filter(is_finite(F.col(cost)))
    ceiling = valid.agg((F.max(cost) + F.max(F.abs(cost)) + COST_MARGIN).alias("v")).scalar()
    sentinel = F.coalesce(ceiling, F.lit(1.7976931348623157e308))
    ok = F.col(cost).isNotNull() & is_finite(F.col(cost))
    return costs.withColumn(cost, F.when(ok, F.col(cost)).otherwise(sentinel))


def _top_score(logits: str) -> Column:
    return sigmoid(F.array_max(logits).cast("double"))


def parity(reference: DataFrame, other: DataFrame, minimum_score: float = 0.3) -> DataFrame:
    """Largest absolute logit and box drift of the queries the reference run is confident about, and their number."""
    confident = reference.filter(_top_score("logits") > minimum_score)
    right = other.select("image_id", "query_idx", *[F.col(c).alias(f"o_{c}") for c in ("logits", "cx", "cy", "w", "h")])
    joined = confident.join(right, ["image_id", "query_idx"])
    logit_drift = F.array_max(F.zip_with("logits", "o_logits", lambda a, b: F.abs(a - b)))
    box_drift = F.greatest(*[F.abs(F.col(c) - F.col(f"o_{c}")) for c in ("cx", "cy", "w", "h")])
    return joined.agg(
        F.max(logit_drift).alias("max_logit_drift"), F.max(box_drift).alias("max_box_drift"), F.count("*").alias("queries")
    )


def cardinality_error(raw: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean absolute difference between confident queries (best score > 0.5) and targets per image."""
    predicted = raw.groupBy("image_id").agg(F.count_if(_top_score("logits") > 0.5).alias("predicted"))
    wanted = targets.groupBy("image_id").agg(F.count("*").alias("wanted"))
    joined = predicted.join(wanted, "image_id", "left")
    gap = F.abs(F.col("predicted") - F.coalesce("wanted", F.lit(0)))
    return joined.agg(F.avg(gap).alias("cardinality_error"), F.count("*").alias("images"))
