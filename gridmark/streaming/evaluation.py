"""Incremental evaluation: each micro-batch of whole images is matched once; summaries are batch queries over the rows.

Input rows are whole images (image_id, detections array, ground_truth array): greedy matching of an image needs all of
it at once, and a row cannot be torn between micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from gridmark.functions import boxes as bx
from gridmark.functions.scalars import grid_position
from gridmark.operators import matching
from gridmark.operators.sweep import DEFAULT_GRID
from gridmark.schemas import DETECTIONS, GROUND_TRUTH


def _without_image(schema: StructType) -> StructType:
    return StructType([f for f in schema.fields if f.name != "image_id"])


IMAGE_ROWS = StructType(
    [
        StructField("image_id", LongType()),
        StructField("detections", ArrayType(_without_image(DETECTIONS))),
        StructField("ground_truth", ArrayType(_without_image(GROUND_TRUTH))),
    ]
)


def pack_images(detections: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """Rows of both tables to whole-image rows."""

    def side(rows: DataFrame, schema: StructType, name: str) -> DataFrame:
        if "area" in schema.names and "area" not in rows.columns:
            rows = rows.withColumn("area", bx.area(bx.box()))
        fields = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _without_image(schema).fields])
        return rows.groupBy("image_id").agg(F.collect_list(fields).alias(name))

    both = side(detections, DETECTIONS, "detections").join(side(ground_truth, GROUND_TRUTH, "ground_truth"), "image_id", "full")
    return both.select("image_id", "detections", "ground_truth")


def unpack_images(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    return images.select("image_id", F.inline("detections")), images.select("image_id", F.inline("ground_truth"))


def match_stream(images: DataFrame, folder: str, checkpoint: str, iou_threshold: float = 0.5) -> DataStreamWriter:
    """Writer that appends matched rows and ground-truth counts of every micro-batch under *folder*.

    Each batch overwrites its own partition folder, so a batch replayed after a failure is not counted twice.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        detections, truth = unpack_images(batch)
        matching.match_greedy(detections, truth, iou_threshold).write.mode("overwrite").parquet(
            f"{folder}/matched/batch={batch_id}"
        )
        matching.ground_truth_counts(truth, detections).write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")
        batch.unpersist()

    return images.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def matched_so_far(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(matched rows, ground-truth counts) of everything streamed so far, for any batch summary."""
    matched = spark.read.parquet(f"{folder}/matched").drop("batch")
    counts = spark.read.parquet(f"{folder}/counts").groupBy("label").agg(F.sum("total_gt").alias("total_gt"))
    return matched, counts


def running_bins(matched: DataFrame, grid: tuple[float, ...] = DEFAULT_GRID) -> DataFrame:
    """Stateful TP and FP counters per class and threshold bin of a stream of matched rows.

    State is classes x bins, whatever the stream's length; use complete or update output.
    """
    score = F.col("score").cast("double")
    counted = matched.filter(~F.col("is_ignored") & ~F.isnan(score)).select(
        "label", grid_position(score, sorted(grid)).alias("bin"), "is_tp"
    )
    return counted.groupBy("label", "bin").agg(
        F.count_if("is_tp").alias("tp"), F.count_if(~F.col("is_tp")).alias("fp")
    )
