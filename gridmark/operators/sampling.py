"""Reproducible selection. Order is the MD5 of seed and key: the same on every run, partitioning and cluster size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: fewer calibration samples than this deserve a warning.
MIN_CALIBRATION_SAMPLES = 32
_PREFIX = 4  # hex digits, so 65,536 buckets


def draw(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def draw_range(df: DataFrame, seed: int, keys: list[str], start, stop) -> DataFrame:
    """Rows whose position in draw order is in [start, stop), without sorting the table.

    Positions are resolved from a histogram over the first digits of the draw. Buckets wholly inside the range are kept
    as they are, so only the bucket or two at its ends (1/65,536 of the rows each) are ordered. *start* and *stop* are
    numbers or one-value columns.
    """
    start = start if isinstance(start, Column) else F.lit(start)
    stop = stop if isinstance(stop, Column) else F.lit(stop)
    drawn = df.withColumn("_draw", draw(seed, *keys)).withColumn("_bucket", F.substring("_draw", 1, _PREFIX))
    histogram = drawn.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = histogram.select(  # at most 65,536 rows
        "_bucket", "_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    ).filter((F.col("_before") < stop) & (F.col("_before") + F.col("_rows") > start))
    touched = drawn.join(F.broadcast(placed), "_bucket")
    whole = (F.col("_before") >= start) & (F.col("_before") + F.col("_rows") <= stop)
    inner = touched.filter(whole)
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_draw", *keys)) - 1
    edges = touched.filter(~whole).withColumn("_position", F.col("_before") + rank)
    edges = edges.filter((F.col("_position") >= start) & (F.col("_position") < stop))
    return inner.select(*df.columns).unionByName(edges.select(*df.columns))


def subset(images: DataFrame, n: int | None, seed: int = 0) -> DataFrame:
    """A reproducible subset of *n* images; all of them without *n*; asking for more than there are is an error."""
    if n is None:
        return images
    have = images.agg(F.count("*").alias("n")).scalar()
    too_few = F.raise_error(F.concat(F.lit(f"requested {n} images, but there are only "), have.cast("string")))
    stop = F.when(have >= n, F.lit(n).cast("long")).otherwise(too_few.cast("long"))
    return draw_range(images, seed, ["image_id"], 0, stop)


def tuning_and_test(images: DataFrame, n_tuning: int, n_test: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts of one draw."""
    return (
        draw_range(images, seed, ["image_id"], 0, n_tuning),
        draw_range(images, seed, ["image_id"], n_tuning, n_tuning + n_test),
    )


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Image ids in both parts; empty for disjoint splits."""
    return left.select("image_id").intersect(right.select("image_id"))


def first_by_name(files: DataFrame, n: int, name: str = "file_name") -> DataFrame:
    """The first *n* files by name with a ``too_few`` flag below the advised sample count."""
    first = files.orderBy(name).limit(n)
    return first.withColumn("too_few", first.agg(F.count("*").alias("n")).scalar() < MIN_CALIBRATION_SAMPLES)


def pad_to_multiple(
    samples: DataFrame, key: str, batch: int, world_size: int = 1, minimum: int = 0, seed: int = 0
) -> DataFrame:
    """Append repeats so the length is a multiple of batch * world size; ``is_repeat`` marks them."""
    unit = batch * world_size
    have = samples.agg(F.count("*").alias("n")).scalar()
    wanted = F.greatest(have, F.lit(minimum).cast("long"))
    padding = F.ceil(wanted / unit) * unit - have
    rest = draw_range(samples, seed, [key], 0, padding % F.greatest(have, F.lit(1)))
    full = F.floor(padding / F.greatest(have, F.lit(1))).cast("int")
    rounds = samples.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), full))).drop("_copy")
    marked = samples.withColumn("is_repeat", F.lit(False))
    return marked.unionByName(rounds.unionByName(rest).withColumn("is_repeat", F.lit(True)))


def sampler_padding(rank: Column, position: Column, world_size: int, length) -> Column:
    """True where a sharded sampler repeats a sample: rank + position * world size is past the end."""
    return rank + position * world_size >= length


def first_rank_owns(results: DataFrame) -> DataFrame:
    """Images reported by several workers: the lowest rank owns an image and all of its detections are kept."""
    owners = results.groupBy("image_id").agg(F.min("rank").alias("rank"))
    return results.join(owners, ["image_id", "rank"], "left_semi")
