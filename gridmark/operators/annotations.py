"""Annotation cleaning and validation. Invalid rows become a rejects table instead of an exception mid-job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.functions import boxes as bx
from gridmark.functions import points as pt
from gridmark.functions.scalars import is_finite

# Image suffixes a packed split may hold.
PACKABLE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")


class RejectedRows(ValueError):
    """Raised in strict mode when a rejects table is not empty."""


def require_no_rejects(rejects: DataFrame) -> None:
    """Strict mode: fail with one example when *rejects* has rows."""
    example = rejects.limit(1).collect()
    if example:
        raise RejectedRows(f"{example[0]['reason']}: {example[0].asDict()}")


def with_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with their annotations; an image without any keeps one row of nulls."""
    return images.join(annotations, "image_id", "left")


def orphans(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations whose image_id matches no image."""
    lost = annotations.join(images.select("image_id"), "image_id", "left_anti")
    return lost.withColumn("reason", F.lit("image_id matches no image"))


def file_name_problem(file_name: Column) -> Column:
    """Null for a usable relative name, else why it is refused."""
    suffix = F.lower(F.regexp_extract(file_name, r"[^/]\.([^./]+)$", 1))
    return (
        F.when(file_name.startswith("/") | file_name.rlike(r"(^|/)\.\.(/|$)"), F.lit("absolute or escaping path"))
        .when(~suffix.isin(*PACKABLE_SUFFIXES), F.lit("unsupported extension"))
    )


def bad_file_names(images: DataFrame) -> DataFrame:
    return images.withColumn("reason", file_name_problem(F.col("file_name"))).filter(F.col("reason").isNotNull())


def _clamped(rows: DataFrame, box: bx.Box) -> DataFrame:
    corners = bx.clamp_to(box, F.col("width").cast("double"), F.col("height").cast("double"))
    kept = rows.select("*", *corners.named("x1", "y1", "x2", "y2"))
    return kept.filter(bx.has_area(bx.box()))


def clean_annotated(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Drop crowds, make corners, clamp to the image, drop empty boxes. The area stays the annotated one."""
    real = annotations.filter(~F.coalesce(F.col("iscrowd"), F.lit(False)))
    sized = real.join(images.select("image_id", "width", "height"), "image_id")
    return _clamped(sized, bx.xywh_to_xyxy(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).drop("x", "y", "w", "h")


def clean_labelled(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """The same clamping for corner boxes from label text; area is recomputed and nothing is a crowd."""
    renamed = boxes.select(*[F.col(c).alias(f"_{c}" if c in ("x1", "y1", "x2", "y2") else c) for c in boxes.columns])
    sized = renamed.join(images.select("image_id", "width", "height"), "image_id")
    cleaned = _clamped(sized, bx.Box(*[F.col(f"_{c}") for c in ("x1", "y1", "x2", "y2")]))
    return cleaned.drop("_x1", "_y1", "_x2", "_y2").withColumns(
        {"area": bx.area(bx.box()), "iscrowd": F.lit(False)}
    )


def detection_problem(scores_required: bool = True) -> Column:
    """Why a detection row is unusable, null when it is fine. Column types are enforced by the schema."""
    finite = is_finite(F.col("x1")) & is_finite(F.col("y1")) & is_finite(F.col("x2")) & is_finite(F.col("y2"))
    checks = F.when(F.col("label").isNull(), F.lit("missing label")).when(
        F.col("label").cast("double") != F.floor(F.col("label").cast("double")), F.lit("label is not integral")
    )
    if scores_required:
        checks = checks.when(F.col("score").isNull(), F.lit("missing score"))
    return checks.when(~F.coalesce(finite, F.lit(False)), F.lit("box is not finite"))


def validate_detections(detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (usable, rejects). NaN scores are usable: they rank last and pass no threshold."""
    checked = detections.withColumn("reason", detection_problem())
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def missing_crowd_flags(ground_truth: DataFrame) -> DataFrame:
    """Ground truths without the one crowd flag every row needs."""
    return ground_truth.filter(F.col("iscrowd").isNull()).withColumn("reason", F.lit("missing crowd flag"))


def segmentation_kind(segmentation: Column) -> Column:
    """'rle', 'polygon' or 'none' of a segmentation kept as JSON text."""
    trimmed = F.trim(segmentation)
    is_rle = F.get_json_object(segmentation, "$.counts").isNotNull() & F.get_json_object(
        segmentation, "$.size"
    ).isNotNull()
    return (
        F.when(trimmed.startswith("{") & is_rle, F.lit("rle"))
        .when(trimmed.startswith("[") & (trimmed != "[]"), F.lit("polygon"))
        .otherwise(F.lit("none"))
    )


def polygons(segmentation: Column) -> Column:
    """Parts with at least three points of a polygon segmentation kept as JSON text."""
    return pt.solid_parts(F.from_json(segmentation, "array<array<double>>"))


def scale_annotations(annotations: DataFrame, sx: Column, sy: Column) -> DataFrame:
    """Rescale boxes, area, polygons and keypoints; visibility is unchanged."""
    changed = {
        "x": F.col("x") * sx,
        "y": F.col("y") * sy,
        "w": F.col("w") * sx,
        "h": F.col("h") * sy,
        "area": F.col("area") * sx * sy,
    }
    if "segmentation" in annotations.columns:
        changed["segmentation"] = pt.scale_polygons(F.col("segmentation"), sx, sy)
    if "keypoints" in annotations.columns:
        changed["keypoints"] = pt.scale_points(F.col("keypoints"), sx, sy)
    return annotations.withColumns(changed)


def pad_keypoints(annotations: DataFrame, count: int) -> DataFrame:
    return annotations.withColumn("keypoints", pt.pad_points(F.col("keypoints"), count))


def fill_num_keypoints(annotations: DataFrame) -> DataFrame:
    """A missing num_keypoints is the count of visible points."""
    counted = F.when(F.col("keypoints").isNotNull(), pt.visible_count(F.col("keypoints")))
    return annotations.withColumn("num_keypoints", F.coalesce("num_keypoints", counted))


def pad_targets(targets: DataFrame, images: DataFrame, count: int, order: list[str]) -> DataFrame:
    """Exactly *count* rows per image with a ``valid`` flag; extra rows are cut in *order*.

    The rank filter is applied before the shuffle by Spark's group limit, so a crowded image costs at most *count*
    rows per map task.
    """
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(*order))
    kept = targets.withColumn("slot", rank).filter(F.col("slot") <= count)
    kept = kept.withColumn("slot", F.col("slot") - 1).withColumn("valid", F.lit(True))
    slots = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("slot"))
    padded = slots.join(kept, ["image_id", "slot"], "left")
    fillers = {"bigint": 0, "int": 0, "double": 0.0, "boolean": False}
    kinds = dict(targets.dtypes)
    return padded.withColumns(
        {c: F.coalesce(F.col(c), F.lit(fillers[k]).cast(k)) for c, k in kinds.items() if k in fillers and c != "image_id"}
        | {"valid": F.coalesce("valid", F.lit(False))}
    )


def crowd_regions(annotations: DataFrame, space: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Crowd annotations as labelled corner boxes, plus rejects. Categories outside *space* are skipped silently."""
    crowds = annotations.filter(F.col("iscrowd"))
    numbers = [F.col(c) for c in ("x", "y", "w", "h")]
    missing_box = numbers[0].isNull() | numbers[1].isNull() | numbers[2].isNull() | numbers[3].isNull()
    checked = crowds.withColumn(
        "reason",
        F.when(F.col("image_id").isNull(), F.lit("missing image_id"))
        .when(F.col("category_id").isNull(), F.lit("missing category_id"))
        .when(missing_box, F.lit("missing bbox")),
    )
    rejects = checked.filter(F.col("reason").isNotNull())
    good = checked.filter(F.col("reason").isNull()).drop("reason")
    if space is None:
        good = good.withColumn("label", F.col("category_id"))
    else:
        good = good.join(space, "category_id")
        # An unmapped category is no reject even when its box is missing.
        rejects = rejects.join(space.select("category_id"), "category_id", "left_semi").unionByName(
            rejects.filter(F.col("category_id").isNull() | F.col("image_id").isNull())
            .join(space.select("category_id"), "category_id", "left_anti")
            .select(*rejects.columns)
        )
    corners = bx.xywh_to_xyxy(*numbers)
    return good.select("image_id", "ann_id", "label", *corners.named()), rejects


def add_crowd_regions(ground_truth: DataFrame, regions: DataFrame) -> DataFrame:
    """Append crowd boxes to each image's own targets, numbered after them by annotation id."""
    crowd = regions.select(
        "image_id",
        F.col("ann_id").alias("gt_idx"),
        "label",
        *bx.box().named(),
        F.lit(True).alias("iscrowd"),
    )
    return ground_truth.select("image_id", "gt_idx", "label", "x1", "y1", "x2", "y2", "iscrowd").unionByName(crowd)


def sample_range_flags(samples: DataFrame, low: float, high: float, values: str = "embedding") -> DataFrame:
    """Smallest and largest entry of every sample vector and whether it leaves [low, high]; NaN never does."""
    smallest, largest = F.array_min(values), F.array_max(values)
    measured = samples.withColumns({"smallest": smallest.cast("double"), "largest": largest.cast("double")})
    outside = (F.col("smallest") < low) | ((F.col("largest") > high) & ~F.isnan("largest"))
    return measured.withColumn("outside", F.coalesce(outside, F.lit(False)))
