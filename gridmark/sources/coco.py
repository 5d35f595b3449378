"""COCO annotation documents in, COCO result records out."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.functions import boxes as bx
from gridmark.operators.labels import to_category_ids
from gridmark.schemas import COCO_DOCUMENT
from gridmark.sources.documents import document_objects


@dataclass(frozen=True)
class CocoTables:
    images: DataFrame
    categories: DataFrame
    annotations: DataFrame  # segmentation stays JSON text: polygons and run-length objects share the field


def _hidden_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Documents whose file names start with an underscore, which Spark's file listing skips; one task reads each."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for file in batch["_path"]:
                system, inner = FileSystem.from_uri(file if "://" in file else os.path.abspath(file))
                with system.open_input_stream(inner) as stream:
                    texts.append(stream.read().decode("utf-8"))
            yield batch.assign(value=texts)

    rows = spark.createDataFrame([(p,) for p in paths], "_path string").repartition(len(paths))
    texts = rows.mapInPandas(load, "_path string, value string")
    return texts.select("_path", F.from_json("value", COCO_DOCUMENT).alias("d")).select("_path", "d.*")


def _hidden_names(spark: SparkSession, path: str) -> list[str]:
    """Documents named ``_annotations.coco.json`` in a folder, or in the folders below it or that a glob names."""
    jvm = spark.sparkContext._jvm
    found = []
    for pattern in (f"{path}/_annotations.coco.json", f"{path}/*/_annotations.coco.json"):
        place = jvm.org.apache.hadoop.fs.Path(pattern)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        uris = [status.getPath().toUri() for status in system.globStatus(place) or []]
        found += [u.getPath() if u.getScheme() in (None, "file") else u.toString() for u in uris]
    return found


def _split_of(path: Column, split: str | None) -> Column:
    """The given split, or else <split>/<file>.json: the folder the document lies in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1) if split is None else F.lit(split)


def read_coco_objects(spark: SparkSession, path: str, split: str | None = None) -> CocoTables:
    """The same tables as :func:`read_coco` from documents that many tasks read, object by object.

    For documents too large for one task each. Names with a leading underscore are not listed.
    """
    objects = document_objects(spark, path)

    def section(name: str) -> DataFrame:
        kind = COCO_DOCUMENT[name].dataType.elementType
        parsed = objects.filter(F.col("section") == name).select("file", F.from_json("text", kind).alias("e"))
        return parsed.select(_split_of(F.col("file"), split).alias("split"), "e")

    return _tables(section("images"), section("categories"), section("annotations"))


def read_coco(spark: SparkSession, path: str, split: str | None = None, one_per_line: bool = False) -> CocoTables:
    """Read one document, a folder or a glob of them; *one_per_line* for files with a document on every line.

    The usual file name ``_annotations.coco.json`` is found in the folder and in its split folders, though Spark does not
    list names with an underscore; such documents are read by the tasks themselves.
    Here a JSON document is one task; :func:`read_coco_objects` spreads large ones. Land the tables once with
    ``save_tables`` and read those afterwards.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    hidden = [path] if name.startswith(("_", ".")) else _hidden_names(spark, path.rstrip("/"))
    if hidden:
        document = _hidden_documents(spark, hidden)
    else:
        document = spark.read.schema(COCO_DOCUMENT).option("multiLine", not one_per_line).json(path)
        document = document.withColumn("_path", F.col("_metadata.file_path"))
    document = document.withColumn("split", _split_of(F.col("_path"), split))
    return _tables(*[document.select("split", F.explode(n).alias("e")) for n in ("images", "categories", "annotations")])


def _tables(images: DataFrame, categories: DataFrame, annotations: DataFrame) -> CocoTables:
    """Tables from rows (split, e) with one object of a document each."""
    images = images.select(F.col("e.id").alias("image_id"), "e.file_name", "e.width", "e.height", "split")
    categories = categories.select(F.col("e.id").alias("category_id"), "e.name", "e.supercategory", "e.keypoints", "split")
    box = F.col("e.bbox")
    four = F.size(box) == 4

    def side(position: int) -> Column:
        return F.when(four, F.get(box, position))

    annotations = annotations.select(
        F.col("e.id").alias("ann_id"),
        "e.image_id",
        "e.category_id",
        side(0).alias("x"),
        side(1).alias("y"),
        side(2).alias("w"),
        side(3).alias("h"),
        "e.area",
        (F.coalesce("e.iscrowd", F.lit(0)) != 0).alias("iscrowd"),
        "e.segmentation",
        "e.keypoints",
        "e.num_keypoints",
        "split",
    )
    return CocoTables(images, categories, annotations)


def save_tables(tables: CocoTables, folder: str) -> None:
    """Land the three tables as Parquet partitioned by split, so later scans prune splits and columns."""
    for name in ("images", "categories", "annotations"):
        getattr(tables, name).write.mode("overwrite").partitionBy("split").parquet(f"{folder}/{name}")


def box_records(detections: DataFrame, categories: DataFrame, space: DataFrame | None = None) -> DataFrame:
    """Result records with an x, y, w, h box; detections of unknown classes are left out."""
    known = to_category_ids(detections, categories, space)
    return known.select("image_id", "category_id", F.array(*bx.xyxy_to_xywh(bx.box())).alias("bbox"), "score")


def mask_records(
    detections: DataFrame, run_lengths: DataFrame, categories: DataFrame, space: DataFrame | None = None
) -> DataFrame:
    """Result records with the mask as uncompressed run lengths, in run order: rows of lengths, or of listed ``counts``."""
    keys = ["image_id", "label", F.col("instance_id").alias("det_idx")]
    if "counts" in run_lengths.columns:
        counts = run_lengths.select(*keys, "counts")
    else:
        counts = run_lengths.groupBy(*keys).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "length"))), lambda r: r["length"]).alias("counts")
        )
    known = to_category_ids(detections.join(counts, ["image_id", "label", "det_idx"]), categories, space)
    size = F.array("height", "width")
    return known.select("image_id", "category_id", F.struct(size.alias("size"), "counts").alias("segmentation"), "score")


def keypoint_records(
    detections: DataFrame, counts: DataFrame, categories: DataFrame, space: DataFrame | None = None
) -> DataFrame:
    """Result records with x, y, v triples cut to the category's number of points."""
    known = to_category_ids(detections, categories, space).join(counts, "category_id", "left")
    cut = F.when(F.col("k").isNotNull(), F.slice("keypoints", F.lit(1), F.col("k") * 3)).otherwise(F.col("keypoints"))
    return known.select("image_id", "category_id", cut.alias("keypoints"), "score")


def write_records(records: DataFrame, path: str, compression: str | None = None) -> None:
    """JSON lines, one file per task; run lengths shrink to a fraction under *compression*."""
    records.write.mode("overwrite").json(path, compression=compression)
