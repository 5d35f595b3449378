"""Label text files: one object per line, as a box, a polygon or a pose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark import scale
from gridmark.functions import boxes as bx
from gridmark.functions.points import visible_count
from gridmark.functions.scalars import is_finite

_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL = r"^[+-]?([nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


# Both usual layouts: <split>/labels/a.txt and labels/<split>/a.txt, and likewise for images. A file elsewhere has split ''.
_SPLIT = r"(?:^|/)(?:{kind}/([^/]+)|([^/]+)/{kind})/[^/]+$"


def _split_of(path: Column, kind: str) -> Column:
    pattern = _SPLIT.format(kind=kind)
    first, second = F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)
    return F.when(first != "", first).otherwise(second)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of every label file with the file's split, stem and 1-based line number."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    place = F.col("_metadata.file_path")
    # Names are taken apart once for each file, not for each of its lines.
    named = files.select(_split_of(place, "labels").alias("split"), F.regexp_extract(place, r"([^/]+)\.txt$", 1).alias("stem"), "value")
    lines = named.select(
        "split",
        "stem",
        F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("_line", "text"),
    )
    return lines.filter(F.trim("text") != "").select("split", "stem", (F.col("_line") + 1).alias("line_no"), "text")


def join_images(images: DataFrame, lines: DataFrame) -> DataFrame:
    """Every image with its label lines; an image without a label file is background and keeps one row of nulls.

    Files meet by split and stem, for a stem may repeat from split to split. An image's split is its column ``split``, or
    else the one in its file name.
    """
    stem = F.regexp_extract(F.regexp_replace("file_name", r"^.*/", ""), r"^(.*?)(\.[^.]*)?$", 1)
    split = F.col("split") if "split" in images.columns else _split_of(F.col("file_name"), "images")
    placed = images.withColumns({"stem": stem, "split": split})
    return placed.join(lines, ["split", "stem"], "left")


def _fields(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda f: f != "")


def _numbers(fields: Column) -> Column:
    return F.transform(
        fields,
        lambda f: F.when(f.rlike(_NUMBER), f.try_cast("double")).when(f.rlike(_SPECIAL), F.lit(float("nan"))),
    )


def _single(value: Column) -> Column:
    return value.cast("float")


def parse_lines(lines: DataFrame, num_classes: int) -> DataFrame:
    """Class, pixel box and pixel polygon of label lines (text, width, height), or a ``reason`` for refusal.

    Five fields are a centre box; seven or more with paired coordinates are a polygon, whose box is its bounds. Polygon
    points are clipped to the last pixel, boxes are not. Coordinates are single precision, as label tools write them.
    """
    parsed = _with_reason(_staged(lines.withColumn("_fields", _fields(F.col("text"))), num_classes), F.col("_reason"))
    return parsed.withColumn("polygon", F.when(F.col("reason").isNull(), _polygon())).drop("_fields", "_n", "_class", "_values", "_reason")


def _with_reason(rows: DataFrame, reason: Column) -> DataFrame:
    # Generated instead of projected, so that a filter on it does not parse the line again.
    return rows.select(*[c for c in rows.columns if c != "reason"], F.explode(F.array(reason)).alias("reason"))


def _polygon() -> Column:
    """Pixel polygon of a staged line, clipped; a box is its four corners."""
    width, height = _single(F.col("width")), _single(F.col("height"))
    corners = F.array(
        F.col("x1"), F.col("y1"), F.col("x2"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("x1"), F.col("y2")
    )
    pixels = F.transform(
        "_values", lambda x, i: F.when(i % 2 == 0, _single(x) * width).otherwise(_single(x) * height).cast("double")
    )
    return F.transform(
        F.when(F.col("_n") == 5, corners).otherwise(pixels),
        lambda x, i: bx.clip(x, 0.0, F.when(i % 2 == 0, F.col("width") - 1).otherwise(F.col("height") - 1).cast("double")),
    )


def _staged(lines: DataFrame, num_classes: int) -> DataFrame:
    """Lines with ``_fields``: their class and box, and as ``_reason`` why they are refused."""
    staged = lines.withColumns(
        {
            "_n": F.size("_fields"),
            "_class": F.get("_fields", 0),
            "_values": _numbers(F.slice("_fields", 2, F.greatest(F.size("_fields") - 1, F.lit(0)))),
        }
    )
    width, height = _single(F.col("width")), _single(F.col("height"))
    v = [F.get("_values", i) for i in range(4)]
    half_w, half_h = v[2] / 2.0, v[3] / 2.0
    centre = [_single(v[0] - half_w), _single(v[1] - half_h), _single(v[0] + half_w), _single(v[1] + half_h)]
    xs = F.transform(F.filter("_values", lambda x, i: i % 2 == 0), _single)
    ys = F.transform(F.filter("_values", lambda x, i: i % 2 == 1), _single)
    bounds = [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]
    is_box = F.col("_n") == 5
    sides = [F.when(is_box, c).otherwise(b) for c, b in zip(centre, bounds)]
    scaled = [(s * (width if i % 2 == 0 else height)).cast("double") for i, s in enumerate(sides)]
    malformed = F.exists("_values", lambda x: x.isNull())
    has_nan = F.exists("_values", lambda x: F.isnan(x))
    integral = F.col("_class").rlike(r"^[+-]?[0-9]+$")
    class_id = F.when(integral, F.col("_class").try_cast("bigint"))
    staged = staged.withColumns(dict(zip(("x1", "y1", "x2", "y2"), scaled)) | {"label": class_id})
    finite = is_finite(F.col("x1")) & is_finite(F.col("y1")) & is_finite(F.col("x2")) & is_finite(F.col("y2"))
    reason = (
        F.when(F.col("_n") < 5, F.lit("too few fields"))
        .when((F.col("_n") > 5) & (F.col("_n") % 2 == 0), F.lit("odd coordinate count"))
        .when(F.col("label").isNull(), F.lit("invalid class id"))
        .when((F.col("label") < 0) | (F.col("label") >= num_classes), F.lit("class id out of range"))
        .when(malformed, F.lit("malformed number"))
        .when(has_nan | ~F.coalesce(finite, F.lit(False)), F.lit("non-finite coordinates"))
    )
    return staged.withColumn("_reason", reason)


def parse_pose_lines(lines: DataFrame, num_classes: int, num_keypoints: int, dim: int) -> DataFrame:
    """Class, pixel box and x, y, v triples of pose lines, or a ``reason``.

    With three numbers per point the third is the visibility. With two, a negative coordinate (tested before clamping)
    or the origin means absent, anything else is visible (2). Absent points are zeros.
    """
    if dim not in (2, 3):
        raise ValueError(f"a keypoint has 2 or 3 numbers, got {dim}")
    expected = 5 + num_keypoints * dim
    staged = lines.withColumn("_all", _fields(F.col("text")))
    boxes = _staged(staged.withColumn("_fields", F.slice("_all", 1, 5)), num_classes)
    points = _numbers(F.slice("_all", 6, num_keypoints * dim)) if num_keypoints else F.array().cast("array<double>")
    boxes = boxes.withColumn("_points", points)
    width, height = _single(F.col("width")), _single(F.col("height"))

    def point(index: Column) -> Column:
        base = index * dim
        x, y = _single(F.get("_points", base)), _single(F.get("_points", base + 1))
        one, zero = F.lit(1.0).cast("float"), F.lit(0.0).cast("float")
        cx, cy = F.least(F.greatest(x, zero), one), F.least(F.greatest(y, zero), one)
        if dim == 3:
            v = _single(F.get("_points", base + 2)).cast("double")
        else:
            absent = (x < 0) | (y < 0) | ((cx == 0) & (cy == 0))
            v = F.when(absent, F.lit(0.0)).otherwise(F.lit(2.0))
        gone = v <= 0
        px = F.when(gone, F.lit(0.0)).otherwise((cx * width).cast("double"))
        py = F.when(gone, F.lit(0.0)).otherwise((cy * height).cast("double"))
        return F.array(px, py, v)

    triples = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(num_keypoints - 1)), point)) if num_keypoints else points
    bad_visibility = F.lit(False)
    if dim == 3:
        bad_visibility = F.exists(
            F.filter("_points", lambda x, i: i % 3 == 2), lambda v: (v < 0) | (v > 2)
        )
    reason = (
        F.when(F.size("_all") != expected, F.lit("wrong field count"))
        .when(F.col("_reason").isNotNull(), F.col("_reason"))
        .when(F.exists("_points", lambda x: x.isNull()), F.lit("malformed number"))
        .when(F.exists("_points", lambda x: F.isnan(x) | F.isnan(_single(x)) | ~is_finite(_single(x))), F.lit("non-finite keypoint"))
        .when(bad_visibility, F.lit("visibility out of range"))
    )
    parsed = _with_reason(boxes, reason).withColumn("keypoints", F.when(F.col("reason").isNull(), triples))
    return parsed.drop("_all", "_points", "_fields", "_n", "_class", "_values", "_reason")


def to_coco(images: DataFrame, objects: DataFrame, class_names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories with sequential ids: images by file name, annotations by image and line.

    ``objects`` holds file_name, line_no, label and a pixel box. Numbering is distributed, never one sorted task.
    """
    numbered = scale.ordered_ids(images.select("file_name", "width", "height"), ["file_name"], "image_id")
    named = objects.drop("image_id", "ann_id")
    placed = named.join(numbered.select("file_name", "image_id"), "file_name")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    extra = []
    if "keypoints" in objects.columns:
        extra = ["keypoints", visible_count(F.col("keypoints")).alias("num_keypoints")]
    rows = placed.select(
        "image_id",
        "line_no",
        F.col("label").alias("category_id"),
        F.col("x1").alias("x"),
        F.col("y1").alias("y"),
        w.alias("w"),
        h.alias("h"),
        (w * h).alias("area"),
        F.lit(False).alias("iscrowd"),
        *extra,
    )
    # Numbering reads its rows twice, to sample their ranges and to deal them out.
    annotations = scale.ordered_ids(scale.stored(rows, "objects"), ["image_id", "line_no"], "ann_id").drop("line_no")
    categories = class_names.select(
        F.col("label").alias("category_id"), "name", F.lit("none").alias("supercategory")
    )
    return numbered, annotations, categories
