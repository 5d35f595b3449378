"""

python scripts/bench_shape.py FOLDER [runs]   writes the tables to FOLDER once and prints seconds of each run.
BENCH_CPUS (default 8) chooses the cores.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from gridmark.operators import average_precision as ap  # noqa: E402
from gridmark.operators import matching  # noqa: E402

IMAGES, DETECTIONS, TRUTHS, CLASSES = 5_000, 300, 36_600, 80


def unit(*key) -> F.Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)


def write_tables(spark: SparkSession, folder: str) -> None:
    corner = lambda name, most: (unit(F.col("id"), F.lit(name)) * most).alias(name)
    truth = spark.range(TRUTHS).select(
        "id", (F.col("id") % IMAGES).alias("image_id"), F.floor(unit(F.col("id"), F.lit("c")) * CLASSES).alias("label"),
        corner("x1", 500), corner("y1", 500), (10 + unit(F.col("id"), F.lit("w")) * 200).alias("w"), (10 + unit(F.col("id"), F.lit("h")) * 200).alias("h"),
    )
    place = F.floor(F.col("id") / IMAGES).alias("gt_idx")
    sides = ["image_id", "label", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2")]
    truth.select(place, *sides, F.lit(False).alias("iscrowd")).write.mode("overwrite").parquet(f"{folder}/truth")
    # Every third detection is a shifted ground truth of its image, the others are anywhere.
    drawn = spark.range(IMAGES * DETECTIONS).select("id", (F.col("id") % IMAGES).alias("image_id"), F.floor(F.col("id") / IMAGES).alias("det_idx"))
    per_image = truth.groupBy("image_id").agg(F.collect_list(F.struct("label", "x1", "y1", "w", "h")).alias("all"))
    near = drawn.join(per_image, "image_id").withColumn("t", F.get("all", (F.col("det_idx") % F.size("all")).cast("int")))
    close = F.col("det_idx") % 3 == 0
    shift = lambda name: (unit(F.col("id"), F.lit(name)) - 0.5) * 30
    rows = near.select(
        "image_id", "det_idx", F.when(close, F.col("t.label")).otherwise(F.floor(unit(F.col("id"), F.lit("c")) * CLASSES)).alias("label"),
        unit(F.col("id"), F.lit("s")).alias("score"),
        F.when(close, F.col("t.x1") + shift("x")).otherwise(unit(F.col("id"), F.lit("x1")) * 500).alias("x1"),
        F.when(close, F.col("t.y1") + shift("y")).otherwise(unit(F.col("id"), F.lit("y1")) * 500).alias("y1"),
        F.when(close, F.col("t.w")).otherwise(10 + unit(F.col("id"), F.lit("w")) * 200).alias("w"),
        F.when(close, F.col("t.h")).otherwise(10 + unit(F.col("id"), F.lit("h")) * 200).alias("h"),
    )
    rows.select("det_idx", "score", *sides).write.mode("overwrite").parquet(f"{folder}/detections")


def main(folder: str, runs: int) -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not os.path.isdir(f"{folder}/detections"):
        write_tables(spark, folder)
    detections, truth = spark.read.parquet(f"{folder}/detections"), spark.read.parquet(f"{folder}/truth")
    print(detections.count(), "detections,", truth.count(), "ground truths,", truth.select("label").distinct().count(), "classes", flush=True)
    for run in range(runs):
        began = time.perf_counter()
        stats = {r.statistic: round(r.value, 4) for r in ap.summarize_boxes(ap.evaluate(detections, truth)).collect()}
        whole = time.perf_counter() - began
        began = time.perf_counter()
        matching.match_lanes(detections, ap.truth_areas(truth), matching.coco_lanes(ap.IOU_GRID), None, 100)
        print(f"run {run}: evaluation {whole:.2f} s, of which matching takes {time.perf_counter() - began:.2f} s; {stats}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 3)
