"""Weekly counts: Monday-to-Sunday sums, deltas, upserts and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_daily(daily: DataFrame, keys: list[str], category: str = "without_mirrors") -> DataFrame:
    """Rejects of a daily table: wrong category, negative or missing counts, and days listed more than once."""
    bad = (
        F.when(~F.col("category").eqNullSafe(category), F.lit("wrong category"))
        .when(F.col("downloads").isNull(), F.lit("missing count"))
        .when(F.col("downloads") < 0, F.lit("negative count"))
    )
    rows = daily.groupBy(*keys, "day").agg(
        F.min(bad).alias("reason"), F.count("*").alias("entries")
    )
    reason = F.coalesce("reason", F.when(F.col("entries") > 1, F.lit("duplicate day")))
    return rows.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def weekly_sums(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Sum per Monday-to-Sunday week with ``complete``: whether all seven days are present."""
    week = F.trunc("day", "week")
    rows = daily.withColumn("week_start", week).groupBy(*keys, "week_start").agg(
        F.sum("downloads").alias("downloads"), F.count_distinct("day").alias("days")
    )
    return rows.select(
        *keys,
        "week_start",
        F.date_add("week_start", 6).alias("week_end"),
        "downloads",
        (F.col("days") == 7).alias("complete"),
    )


def with_deltas(history: DataFrame, keys: list[str]) -> DataFrame:
    """new_stars against the week before, null when that week is missing."""
    order = Window.partitionBy(*keys).orderBy("week_start")
    contiguous = F.date_add(F.lag("week_end").over(order), 1) == F.col("week_start")
    delta = F.when(contiguous, F.col("stars_total") - F.lag("stars_total").over(order))
    return history.withColumn("new_stars", delta)


def history_problems(history: DataFrame, keys: list[str]) -> DataFrame:
    """Checkpoints that break a rule, with the reason."""
    order = Window.partitionBy(*keys).orderBy("week_start", "week_end")
    expected = with_deltas(history.withColumnRenamed("new_stars", "_given"), keys)
    previous = F.lag("week_start").over(order)
    reason = (
        F.when(
            (F.weekday("week_start") != 0) | (F.col("week_end") != F.date_add("week_start", 6)),
            F.lit("not one Monday-to-Sunday week"),
        )
        .when((F.col("stars_total") < 0) | (F.col("downloads") < 0), F.lit("negative count"))
        .when(previous == F.col("week_start"), F.lit("not strictly chronological"))
        .when(previous.isNotNull() & ~F.col("_given").eqNullSafe(F.col("new_stars")), F.lit("wrong delta"))
    )
    return expected.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def keep_latest(history: DataFrame, keys: list[str], limit: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("week_start").desc())
    return history.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def upsert_week(history: DataFrame, week: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Record one week per series. Returns (new history, rejects).

    A rerun of the latest week refreshes downloads but keeps the first cumulative reading and its delta. A week older
    than the latest checkpoint is refused.
    """
    newest = history.groupBy(*keys).agg(
        F.max("week_start").alias("_latest"),
        F.max_by("week_end", "week_start").alias("_latest_end"),
        F.max_by("stars_total", "week_start").alias("_latest_stars"),
    )
    placed = week.join(newest, keys, "left")
    rejects = placed.filter(F.col("week_start") < F.col("_latest")).select(
        *keys, "week_start", F.lit("older than the latest checkpoint").alias("reason")
    )
    contiguous = F.date_add("_latest_end", 1) == F.col("week_start")
    fresh = placed.filter(F.col("_latest").isNull() | (F.col("week_start") >= F.col("_latest"))).select(
        *keys,
        "week_start",
        F.col("week_end").alias("_end"),
        F.col("stars_total").alias("_stars"),
        F.when(contiguous, F.col("stars_total") - F.col("_latest_stars")).alias("_delta"),
        F.col("downloads").alias("_downloads"),
        F.lit(True).alias("_fresh"),
    )
    merged = history.withColumn("_old", F.lit(True)).join(fresh, [*keys, "week_start"], "full")
    new_history = merged.select(
        *keys,
        "week_start",
        F.coalesce("week_end", "_end").alias("week_end"),
        F.coalesce("stars_total", "_stars").alias("stars_total"),
        F.when(F.col("_old"), F.col("new_stars")).otherwise(F.col("_delta")).alias("new_stars"),
        F.coalesce("_downloads", "downloads").alias("downloads"),
    )
    return new_history, rejects
