"""Metrics, daily counts, shards and their index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark import scale
from gridmark.operators import sharding
from gridmark.operators.annotations import require_no_rejects
from gridmark.operators.runs import split_metric
from gridmark.operators.weekly import check_daily
from gridmark.schemas import DAILY_COUNTS, SHARD_INDEX
from gridmark.sources.lines import numbered_lines

# Index version and the two category-id policies.
INDEX_VERSION = 1
POLICIES = ("remap", "raw")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Training metrics CSV as long rows (run, epoch, step, column, split, metric, value). ``epoch`` is required.

    Every file is read by its own first line, so runs may have other columns or another order of them. Metrics are plain
    numbers: a cell is quoted at most as a whole. Long logs are read by many tasks.
    """
    lines = numbered_lines(spark, path, "*.csv").filter(F.trim("text") != "")

    def cells(line: Column) -> Column:
        return F.transform(F.split(line, ","), lambda c: F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"))

    heads = lines.groupBy("file_path").agg(F.min_by("text", "line_no").alias("header"), F.min("line_no").alias("first"))
    # One row per file, read twice: checked, and joined to the file's lines.
    heads = scale.cut_lineage(heads.withColumn("header", cells(F.col("header"))))
    if not heads.filter(~F.array_contains("header", "epoch")).isEmpty():
        raise ValueError("a metrics file has no 'epoch' column")
    run = F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1)
    rows = lines.join(heads, "file_path").filter(F.col("line_no") > F.col("first"))
    rows = rows.select(run.alias("run"), "header", cells(F.col("text")).alias("cells"))

    def named(name: str) -> Column:
        return F.get("cells", F.array_position("header", name).cast("int") - 1).try_cast("double").cast("int")

    # An empty cell is no value; a text that is not a number is no value either.
    pairs = F.arrays_zip(F.col("header").alias("column"), F.col("cells").alias("text"))
    long = rows.select("run", named("epoch").alias("epoch"), named("step").alias("step"), F.explode(pairs).alias("x"))
    long = long.select("run", "epoch", "step", F.col("x.column").alias("column"), F.col("x.text").try_cast("double").alias("value"))
    long = long.filter(~F.col("column").isin("epoch", "step") & F.col("value").isNotNull())
    split, metric = split_metric(F.col("column"))
    return long.withColumns({"split": split, "metric": metric})


def read_daily_counts(spark: SparkSession, path: str, category: str = "without_mirrors") -> DataFrame:
    """Daily counts, refused as a whole when any row breaks a rule."""
    daily = spark.read.schema(DAILY_COUNTS).option("header", True).csv(path)
    require_no_rejects(check_daily(daily, [], category))
    return daily


def shard_index(planned: DataFrame, content: list[str], policy: str = "remap") -> DataFrame:
    """The index of planned samples: one row per shard with counts, digest and the split's content token."""
    shards = sharding.content_digests(planned, content)
    return shards.join(sharding.generation(shards), "split").select(
        F.lit(INDEX_VERSION).alias("version"),
        "split",
        F.lit(policy).alias("policy"),
        "shard_id",
        "samples",
        "bytes",
        "generation",
        "digest",
    )


def write_shards(planned: DataFrame, index: DataFrame, folder: str) -> None:
    """One Parquet file per shard under split/shard folders, then the small index, so a reader of the index finds all.

    A shard is bounded by the plan's byte limit, so one task writing it is bounded too.
    """
    placed = planned.repartition("split", "shard_id").sortWithinPartitions("split", "shard_id", "position")
    placed.write.mode("overwrite").partitionBy("split", "shard_id").parquet(f"{folder}/shards")
    index.coalesce(1).write.mode("overwrite").partitionBy("split").parquet(f"{folder}/index")


def index_problems(index: DataFrame, split: str) -> DataFrame:
    reason = (
        F.when(~F.col("version").eqNullSafe(INDEX_VERSION), F.lit("unsupported version"))
        .when(~F.coalesce(F.col("policy").isin(*POLICIES), F.lit(False)), F.lit("unknown category policy"))
        .when(~F.col("split").eqNullSafe(split), F.lit("index of another split"))
    )
    return index.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def read_shard_index(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Index rows of one split; wrong version, policy or split is an error."""
    index = spark.read.schema(SHARD_INDEX).parquet(f"{folder}/index").filter(F.col("split") == split)
    require_no_rejects(index_problems(index, split))
    if index.isEmpty():
        raise ValueError(f"no index for split {split!r}")
    return index
