"""Helpers that keep operators safe on very large and very skewed inputs.

Nothing here brings rows to the driver. A *probe* is an action that returns one boolean about group sizes; it lets an
operator take a one-shuffle plan while every group is small and a fully distributed plan for the groups that are not.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Largest (image, class) group that may be folded inside one row, detections and ground truths together.
GROUP_ROW_LIMIT = 2_000
# Bytes of an operator's input whose intermediate files may be on disk together, see `in_parts`.
PART_BYTES = 256 << 20
# Folders made for the part that is being computed.
_PART_FOLDERS: ContextVar[list[str] | None] = ContextVar("part_folders", default=None)
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare_checkpoints(spark: SparkSession) -> str:
    """Return the checkpoint folder, using the cluster's own setting and a private one only in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="gridmark-checkpoint-"))
        else:
            raise ValueError("Set spark.checkpoint.dir to a folder every executor can read.")
    return configured or context.getCheckpointDir()


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run's files under the shared checkpoint folder."""
    path = f"{prepare_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"
    if (folders := _PART_FOLDERS.get()) is not None:
        folders.append(path)
    return path


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files, which else stay until the driver collects its garbage."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise *df* in the shared checkpoint folder, so a lost executor re-reads it instead of recomputing it."""
    prepare_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """*df* as a table in the shared checkpoint folder: lost executors re-read it, and readers take only what they need."""
    path = run_folder(df.sparkSession, name)
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`stored` wrote and nothing reads any more."""
    _delete(df.sparkSession, {file.rsplit("/", 1)[0] for file in df.inputFiles()})


def _delete(spark: SparkSession, folders: set[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def part_count(table: DataFrame) -> int:
    """Parts for :func:`in_parts` by the size of the files of a stored table."""
    leaves = table._jdf.queryExecution().analyzed().collectLeaves()
    return 1 + sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())) // PART_BYTES


def in_parts(parts: int, key: str, inputs: Sequence[DataFrame], build: Callable[..., DataFrame], name: str) -> DataFrame:
    """``build(*inputs)``, computed for one part of the values of *key* after the other, so that what it shuffles and stores
    on its way is on disk for one part at a time. Each part is a distributed job over all partitions.

    Rows of different keys must not meet in *build*, and its result must have *key* from the inputs. An input should be
    such that Spark can filter it by *key* before its own shuffles, a stored table for instance; else it is computed for
    every part. With one part nothing runs here.
    """
    if parts == 1:
        return build(*inputs)
    spark = inputs[0].sparkSession
    path = run_folder(spark, name)
    number = F.pmod(F.xxhash64(key), F.lit(parts))
    for part in range(parts):
        folders: list[str] = []
        token = _PART_FOLDERS.set(folders)
        try:
            result = build(*[table.filter(number == part) for table in inputs])
            with shuffles_released(spark):
                result.write.mode("append").parquet(path)
        finally:
            _PART_FOLDERS.reset(token)
        _delete(spark, set(folders))
    return spark.read.schema(result.schema).parquet(path)


def any_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def slice_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ordered_ids(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """Number rows 0..n-1 in *order* without a single-task sort.

    The rows are range-partitioned and materialised once; a row's id is its position inside its slice plus the rows in
    the slices before it. *order* must identify a row.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    slices = slice_count(df.sparkSession)
    placed = cut_lineage(
        df.repartitionByRange(slices, *columns)
        .sortWithinPartitions(*columns)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_position", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # One row per slice, so this window and the broadcast below are bounded by the partition count.
    before = placed.groupBy("_slice").agg(F.count("*").alias("_rows"))
    before = before.withColumn(
        "_before",
        F.coalesce(
            F.sum("_rows").over(Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).select("_slice", "_before")
    return (
        placed.join(F.broadcast(before), "_slice")
        .withColumn(name, F.col("_before") + F.col("_position") + F.lit(start))
        .drop("_slice", "_position", "_before")
    )


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str],
    *,
    large: bool,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums (name -> SQL of a BIGINT value) inside *groups* along *order* (SQL sort terms).

    ``large=False`` is one window per group. ``large=True`` is a two-level scan for groups too big for one task: range
    slices are summed on their own, then shifted by the total of the slices before them. The slice totals number at
    most partitions + groups.
    """
    last = "CURRENT ROW" if inclusive else "1 PRECEDING"
    by, along = ", ".join(groups), ", ".join(order)

    def over(value: str, partition: str, sort: str, end: str) -> str:
        frame = f"ROWS BETWEEN UNBOUNDED PRECEDING AND {end}"
        return f"coalesce(sum({value}) OVER (PARTITION BY {partition} ORDER BY {sort} {frame}), 0L)"

    if not large:
        return df.selectExpr("*", *[f"{over(v, by, along, last)} AS {n}" for n, v in sums.items()])
    placed = order_slices(df, groups, order)
    totals = placed.groupBy(*groups, "_slice").agg(*[F.expr(f"sum({v}) AS _total_{n}") for n, v in sums.items()])
    offsets = totals.selectExpr(
        *groups, "_slice", *[f"{over(f'_total_{n}', by, '_slice', '1 PRECEDING')} AS _before_{n}" for n in sums]
    )
    inner = placed.selectExpr("*", *[f"{over(v, by + ', _slice', along, last)} AS {n}" for n, v in sums.items()])
    joined = inner.join(offsets, [*groups, "_slice"])
    return joined.selectExpr(*df.columns, *[f"{n} + _before_{n} AS {n}" for n in sums])


def sort_column(term: str) -> Column:
    return F.expr(term[: -len(" DESC")]).desc() if term.upper().endswith(" DESC") else F.expr(term).asc()


def order_slices(df: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Tag rows with ``_slice``: consecutive ranges of about equal size in (groups, order), numbered in that order.

    Materialised, because range borders are sampled and every use must see the same ones.
    """
    columns = [F.col(g) for g in groups] + [sort_column(term) for term in order]
    ranged = df.repartitionByRange(slice_count(df.sparkSession), *columns)
    return cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))
