"""Category tables: parent filtering, label spaces, names and category/label mapping.

A category table has one row per class a model can name, so its windows are bounded by the class count, never by the
annotations. No broadcast is forced: Spark broadcasts a category table only when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Supercategory texts that mean "no parent".
NO_PARENT = ("", "none", "null")
BACKGROUND_NAME = "__background__"


def annotated_category_ids(annotations: DataFrame) -> DataFrame:
    return annotations.select("category_id").distinct()


def observed_classes(*frames: DataFrame) -> DataFrame:
    """Classes seen on any side; each side is made distinct before the union, so little is shuffled."""
    seen = frames[0].select("label").distinct()
    for frame in frames[1:]:
        seen = seen.unionAll(frame.select("label").distinct())
    return seen.distinct()


def drop_parent_categories(categories: DataFrame, annotations: DataFrame) -> DataFrame:
    """Remove grouping categories: named as another row's supercategory and without annotations of their own.

    When that would remove every category, all are kept.
    """
    parent = F.coalesce(F.col("supercategory"), F.lit("none"))
    parents = (
        categories.filter(~parent.isin(*NO_PARENT) & ~parent.eqNullSafe(F.col("name")))
        .select(parent.alias("name"))
        .distinct()
        .withColumn("_is_parent", F.lit(True))
    )
    used = annotated_category_ids(annotations).withColumn("_is_used", F.lit(True))
    marked = (
        categories.join(parents, "name", "left")
        .join(used, "category_id", "left")
        .withColumn("_keep", F.col("_is_parent").isNull() | F.col("_is_used").isNotNull())
    )
    any_kept = marked.agg(F.coalesce(F.max("_keep"), F.lit(False)).alias("_any"))
    return marked.filter(F.col("_keep") | ~any_kept.scalar()).select(*categories.columns)


def label_space(categories: DataFrame) -> DataFrame:
    """category_id -> label: the position among the id-sorted categories. Derive once from train and reuse."""
    position = F.row_number().over(Window.orderBy("category_id")) - 1
    return categories.select("category_id", position.cast("long").alias("label"))


def names_by_label(categories: DataFrame, space: DataFrame | None = None) -> DataFrame:
    """One row per label from 0 to the largest; labels without a category have an empty name."""
    mapped = categories.select("category_id", "name")
    mapped = mapped.join(space, "category_id") if space is not None else mapped.withColumn("label", F.col("category_id"))
    every = mapped.agg(F.max("label").alias("top")).select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("label"))
    return every.join(mapped, "label", "left").select("label", F.coalesce("name", F.lit("")).alias("name"))


def keypoint_slots(categories: DataFrame, annotations: DataFrame, slot_counts: list[int]) -> DataFrame:
    """category_id -> slot: keypoint categories take slots with points in id order, the others the free slots.

    The result carries ``problem``, null when the assignment is valid.
    """
    active = [i for i, n in enumerate(slot_counts) if n > 0]
    with_points = annotations.filter(
        (F.coalesce(F.size("keypoints"), F.lit(0)) > 0) | (F.coalesce(F.col("num_keypoints"), F.lit(0)) > 0)
    )
    bearing = annotated_category_ids(with_points).withColumn("_bears", F.lit(True))
    declared = F.coalesce(F.size("keypoints"), F.lit(0)) > 0
    any_declared = categories.agg(F.coalesce(F.max(declared), F.lit(False)).alias("_any")).scalar()
    # Annotations decide only when no category declares its points.
    has_points = F.when(any_declared, declared).otherwise(F.col("_bears").isNotNull())
    marked = categories.join(bearing, "category_id", "left").withColumn("_points", has_points)
    ordered = marked.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_points").orderBy("category_id")) - 1
    )
    total = marked.agg(F.count("*").alias("_total")).scalar()
    bearing_count = marked.agg(F.count_if("_points").alias("_bearing")).scalar()
    top = (max(active) + 1) if active else 0
    required = F.greatest(total, F.lit(top))
    active_array = F.array(*[F.lit(s) for s in active]).cast("array<bigint>")
    taken = F.slice(active_array, 1, bearing_count.cast("int")) if active else active_array
    free = F.array_except(F.sequence(F.lit(0).cast("long"), required - 1), taken)
    position = F.col("_rank").cast("int")
    slot = F.when(F.col("_points"), F.get(active_array, position)).otherwise(F.get(free, position))
    problem = (
        F.when(F.lit(not active), F.lit("no active keypoint slots"))
        .when(bearing_count == 0, F.lit("no keypoint categories"))
        .when(bearing_count > len(active), F.lit("more keypoint categories than slots"))
        .when(slot.isNull(), F.lit("no free slot"))
    )
    return ordered.select("category_id", slot.alias("slot"), problem.alias("problem"))


def to_labels(rows: DataFrame, space: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Map category_id to label. Returns (mapped rows, rejects with a reason for unknown ids)."""
    mapped = rows.join(space, "category_id", "left")
    good = mapped.filter(F.col("label").isNotNull())
    bad = mapped.filter(F.col("label").isNull()).drop("label").withColumn("reason", F.lit("unknown category_id"))
    return good, bad


def to_category_ids(detections: DataFrame, categories: DataFrame, space: DataFrame | None = None) -> DataFrame:
    """label -> category_id; detections that map to no known category are dropped.

    Without *space* labels already are category ids. An identity *space* gives the same result either way.
    """
    known = categories.select("category_id").distinct()
    if space is None:
        return detections.withColumn("category_id", F.col("label")).join(known, "category_id", "left_semi")
    return detections.join(space.select("label", "category_id"), "label").join(known, "category_id", "left_semi")


def name_classes(detections: DataFrame, names: DataFrame, background_label: int | None = None) -> DataFrame:
    """Attach class_name. An unmapped background label is named as such, any other unmapped label is empty."""
    joined = detections.join(names.select("label", F.col("name").alias("_name")), "label", "left")
    fallback = F.lit("")
    if background_label is not None:
        fallback = F.when(F.col("label") == background_label, F.lit(BACKGROUND_NAME)).otherwise(F.lit(""))
    return joined.withColumn("class_name", F.coalesce("_name", fallback)).drop("_name")
