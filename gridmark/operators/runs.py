"""Reduction of training-run metrics and latency samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark import scale

# Metric groups with the texts that put a column into them and the texts that keep it out.
METRIC_GROUPS = (
    ("Detection AP@0.50", r"mAP_50", r"mAP_50_95|mAP_75"),
    ("Detection AP@0.50:0.95", r"mAP_50_95|/AP/", None),
    ("Detection AP@0.75", r"mAP_75", None),
    ("Detection AR", r"mAR", r"keypoint_"),
    ("Keypoint AP@0.50", r"keypoint_map_50", r"map_50_95|map_75"),
    ("Keypoint AP@0.50:0.95", r"keypoint_map_50_95", None),
    ("Keypoint AP@0.75", r"keypoint_map_75", None),
    ("Keypoint AR", r"keypoint_mAR", None),
    ("F1 / Precision / Recall", r"F1|precision|recall", None),
)
SPLITS = ("train", "val", "test")
# Epochs of a run that one task smooths.
RANGE_ROWS = 100_000


def split_metric(column: Column) -> tuple[Column, Column]:
    """'val/mAP' to ('val', 'mAP'); a name without a known split prefix stays whole."""
    prefix = F.split_part(column, F.lit("/"), F.lit(1))
    known = prefix.isin(*SPLITS) & column.contains("/")
    rest = F.substr(column, F.length(prefix) + 2)
    return F.when(known, prefix).otherwise(F.lit("")), F.when(known, rest).otherwise(column)


def long_metrics(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Wide sparse metrics to one row per value, with split and metric name."""
    values = [c for c in wide.columns if c not in keys]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in values])
    rows = wide.select(*keys, F.inline(cells)).filter(F.col("value").isNotNull())
    split, metric = split_metric(F.col("column"))
    return rows.withColumns({"split": split, "metric": metric})


def epoch_statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean per epoch with a band of one sample standard deviation."""
    stats = rows.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return stats.withColumns({"low": F.col("mean") - F.col("std"), "high": F.col("mean") + F.col("std")})


def metric_groups(rows: DataFrame) -> DataFrame:
    """Assign metric columns that hold any value to their groups; a column may belong to several.

    Auxiliary losses, whose name ends in _<number>, are left out of the loss group.
    """
    columns = rows.filter(F.col("value").isNotNull() & ~F.isnan("value")).select("column").distinct()
    name = F.col("column")
    leaf = F.lower(F.regexp_extract(name, r"([^/]*)$", 1))
    is_loss = ~name.isin("epoch", "step") & ~leaf.rlike(r"_\d+$") & (leaf.contains("loss") | leaf.startswith("kp_"))
    memberships = [F.when(is_loss, F.lit("Loss"))]
    tracked = name.rlike(r"^(train|val|test)/")
    for group, include, exclude in METRIC_GROUPS:
        rule = tracked & name.rlike(include)
        if exclude is not None:
            rule = rule & ~name.rlike(exclude)
        if group == "Detection AP@0.50:0.95":
            # A per-class AP column counts unless it names another mAP_50 metric.
            rule = rule & (~name.contains("mAP_50") | name.contains("mAP_50_95"))
        memberships.append(F.when(rule, F.lit(group)))
    groups = F.filter(F.array(*memberships), lambda g: g.isNotNull())
    return columns.select("column", F.explode(groups).alias("metric_group"))


def drop_trailing_evaluations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Remove epochs at a run's end that hold only val/test values; a run without train values is left alone."""
    trained, evaluated = F.col("split") == "train", F.col("split").isin("val", "test")
    flags = rows.groupBy(*keys, "epoch").agg(
        F.max(trained).alias("_trained"), F.max(evaluated).alias("_evaluated")
    )
    limits = flags.groupBy(*keys).agg(
        F.max(F.when(F.col("_trained") | ~F.col("_evaluated"), F.col("epoch"))).alias("_last"),
        F.max("_trained").alias("_any_train"),
    )
    joined = rows.join(limits, keys)
    return joined.filter(~F.col("_any_train") | (F.col("epoch") <= F.col("_last"))).drop("_last", "_any_train")


def best_so_far(
    values: DataFrame, keys: list[str], order: list[str], better: str = "large", initial: float = 0.0, epoch: str = "epoch"
) -> DataFrame:
    """Best value up to each step and the first epoch that reached it (-1 while the initial value stands).

    Only a strict improvement counts, and NaN never improves.
    """
    sign = 1 if better == "large" else -1
    clean = F.when(~F.isnan("value"), F.col("value") * sign)
    window = Window.partitionBy(*keys).orderBy(*order)
    past = window.rowsBetween(Window.unboundedPreceding, -1)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    start = F.lit(initial * sign)
    before = F.greatest(start, F.coalesce(F.max(clean).over(past), start))
    marked = values.withColumn("improved", F.coalesce(clean > before, F.lit(False)))
    best = F.greatest(start, F.coalesce(F.max(clean).over(upto), start)) * sign
    best_epoch = F.coalesce(F.last(F.when(F.col("improved"), F.col(epoch)), ignorenulls=True).over(upto), F.lit(-1))
    return marked.withColumns({"best": best, "best_epoch": best_epoch})


def best_by_track(values: DataFrame, keys: list[str], better: str = "large", initial: float = 0.0) -> DataFrame:
    """Final best of the regular, EMA and combined tracks from rows (epoch, is_ema, value)."""
    tracks = values.withColumn(
        "track", F.explode(F.array(F.lit("all"), F.when(F.col("is_ema"), F.lit("ema")).otherwise(F.lit("regular"))))
    )
    steps = best_so_far(tracks, [*keys, "track"], ["epoch", "is_ema"], better, initial)
    order = F.struct("epoch", "is_ema")
    return steps.groupBy(*keys, "track").agg(
        F.max_by("best", order).alias("best"), F.max_by("best_epoch", order).alias("best_epoch")
    )


def _fold_values(values: list[float | None], alpha: float, start: float | None) -> Iterator[float | None]:
    for value in values:
        start = None if start is None or value is None else start * alpha + value * (1.0 - alpha)
        yield start


def smooth(values: DataFrame, keys: list[str], alpha: float, skip_epochs: int = 0) -> DataFrame:
    """Exponential smoothing of one value per epoch, starting from 0; skipped epochs warm it up but are not reported.

    One step is an affine map of the smoothed value, and so are many steps. A run of more than RANGE_ROWS epochs is cut into
    ranges: each range gives its map, the maps before a range give its start (a few numbers per run), and then every range
    is smoothed on its own. So a long run is many tasks, and agrees with one long fold up to rounding; shorter ones are
    that fold. A value that is null makes it and all later ones null.
    """
    kinds = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys)
    rows = values.select(*keys, F.col("epoch").cast("int").alias("epoch"), F.col("value").cast("double").alias("value"))
    same_run = [F.col(f"_long_{k}").eqNullSafe(F.col(k)) for k in keys]
    long_runs = rows.groupBy(*keys).count().filter(F.col("count") > RANGE_ROWS)
    long_runs = scale.cut_lineage(long_runs.select(*[F.col(k).alias(f"_long_{k}") for k in keys]))

    def in_order(table: pa.Table) -> pa.Table:
        return table.sort_by([("epoch", "ascending"), ("value", "ascending")])

    def whole(table: pa.Table) -> pa.Table:
        last = None
        for last in _fold_values(in_order(table)["value"].to_pylist(), alpha, 0.0):
            pass
        head = table.slice(0, 1).select([*keys, "_slice"])
        head = head.append_column("_factor", pa.array([alpha**table.num_rows], pa.float64()))
        return head.append_column("_added", pa.array([last], pa.float64()))

    def steps(table: pa.Table) -> pa.Table:
        table = in_order(table)
        found = pa.array(_fold_values(table["value"].to_pylist(), alpha, table["_start"][0].as_py()), pa.float64())
        return table.select([*keys, "epoch"]).append_column("smoothed", found)

    def fold(table: pa.Table) -> pa.Table:
        table = in_order(table)
        found = pa.array(_fold_values(table["value"].to_pylist(), alpha, 0.0), pa.float64())
        return table.select([*keys, "epoch"]).append_column("smoothed", found)

    out = f"{kinds}, epoch int, smoothed double"
    if not scale.any_rows(long_runs):
        return rows.groupBy(*keys).applyInArrow(fold, out).filter(F.col("epoch") >= skip_epochs)
    short = rows.join(long_runs, same_run, "left_anti").groupBy(*keys).applyInArrow(fold, out)
    placed = scale.order_slices(rows.join(long_runs, same_run, "left_semi"), keys, ["epoch", "value"])
    maps = placed.groupBy(*keys, "_slice").applyInArrow(whole, f"{kinds}, _slice int, _factor double, _added double")
    # One element per range of a run.
    listed = F.array_sort(F.collect_list(F.struct("_slice", "_factor", "_added")))
    starts = F.aggregate(
        listed,
        F.expr("named_struct('start', 0.0D, 'out', CAST(array() AS array<struct<_slice: int, _start: double>>))"),
        lambda acc, m: F.struct(
            (acc["start"] * m["_factor"] + m["_added"]).alias("start"),
            F.concat(acc["out"], F.array(F.struct(m["_slice"].alias("_slice"), acc["start"].alias("_start")))).alias("out"),
        ),
    )
    known = maps.groupBy(*keys).agg(starts["out"].alias("_starts")).select(*[F.col(k).alias(f"_own_{k}") for k in keys], F.inline("_starts"))
    known = known.withColumnRenamed("_slice", "_own_slice")
    same = F.col("_slice") == F.col("_own_slice")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_own_{k}"))
    begun = placed.join(known, same).select(placed.columns + ["_start"])
    smoothed = begun.groupBy(*keys, "_slice").applyInArrow(steps, out)
    return short.unionByName(smoothed).filter(F.col("epoch") >= skip_epochs)


def early_stop(
    values: DataFrame,
    keys: list[str],
    patience: int = 10,
    min_delta: float = 0.001,
    use_ema: bool = False,
    skip_epochs: int = 0,
) -> DataFrame:
    """Epoch at which a run stops, null when it never does, from rows (epoch, regular, ema).

    The monitored value is the EMA metric when asked for and present, else the larger of both. A non-finite value stops
    at once. Improvement means more than the best so far plus min_delta. What a step decides depends on all before it, so
    runs are spread over tasks and each is read in order, batch by batch, with three numbers kept and no list.
    """
    regular, ema = F.col("regular"), F.col("ema")
    larger = F.coalesce(F.greatest(regular, ema), regular, ema)
    effective = F.coalesce(ema, larger) if use_ema else larger
    usable = values.filter(F.col("epoch") >= skip_epochs).withColumn("value", effective.cast("double"))
    usable = usable.filter(F.col("value").isNotNull()).withColumn("_run", F.to_json(F.struct(*keys)))
    rows = usable.select("_run", *keys, F.col("epoch").cast("int").alias("epoch"), "value")
    ordered = rows.repartition("_run").sortWithinPartitions("_run", "epoch", "value")
    kinds = [f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, head, best, waited, stopped = None, None, -math.inf, 0, None

        def result() -> pa.RecordBatch:
            columns = [*head.columns, pa.array([best], pa.float64()), pa.array([stopped], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, [*keys, "best", "stopped_epoch"])

        for batch in batches:
            names = batch.column("_run").to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            epochs, found = batch.column("epoch").to_pylist(), batch.column("value").to_pylist()
            for start, end in zip(borders[:-1], borders[1:], strict=True):
                if start == end:
                    continue
                if names[start] != current:
                    if head is not None:
                        yield result()
                    current, head = names[start], batch.slice(start, 1).select(keys)
                    best, waited, stopped = -math.inf, 0, None
                for epoch, value in zip(epochs[start:end], found[start:end], strict=True):
                    if stopped is not None:
                        break
                    if math.isfinite(value) and value - min_delta > best:
                        best, waited = value, 0
                    else:
                        waited += 1
                        if waited >= patience or not math.isfinite(value):
                            stopped = epoch
        if head is not None:
            yield result()

    return ordered.mapInArrow(run, ", ".join([*kinds, "best double", "stopped_epoch int"]))


def latency_statistics(timings: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population standard deviation, median and linearly interpolated 95th percentile.

    Percentiles are exact without holding a group's values: rows get their rank in range slices, and only the two
    neighbours of each position are kept. Rows without a time count as calls only; keys must not be null.
    """
    totals = timings.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.avg("ms").alias("mean_ms"),
        F.stddev_pop("ms").alias("std_ms"),
        F.count("ms").alias("_n"),
    )
    timed = timings.filter(F.col("ms").isNotNull()).select(*keys, F.col("ms").cast("double").alias("ms"))
    ranked = scale.running_totals(timed, keys, ["ms"], {"_rank": "1L"}, large=True, inclusive=False)
    placed = ranked.join(totals.select(*keys, "_n"), keys)

    def at(share: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(share)
        low = F.floor(place)
        below = F.max(F.when(F.col("_rank") == low, (1 - (place - low)) * F.col("ms")))
        above = F.max(F.when(F.col("_rank") == low + 1, (place - low) * F.col("ms")))
        return below + F.coalesce(above, F.lit(0.0))

    found = placed.groupBy(*keys).agg(at(0.5).alias("median_ms"), at(0.95).alias("p95_ms"))
    return totals.drop("_n").join(found, keys, "left")


def throughput(batch: Column, mean_ms: Column) -> Column:
    """Images per second, infinite for a zero latency."""
    safe = F.when(mean_ms != 0, F.lit(1000.0) / mean_ms).otherwise(F.lit(float("inf")))
    return batch * safe


def result_rows(forward: DataFrame, end_to_end: DataFrame, keys: list[str]) -> DataFrame:
    """Throughput rows per configuration; the end-to-end latency is used when there is one."""
    left = forward.select(*keys, F.col("mean_ms").alias("forward_ms"))
    right = end_to_end.select(*keys, F.col("mean_ms").alias("end_to_end_ms"))
    joined = left.join(right, keys, "full")
    scope = F.coalesce("end_to_end_ms", "forward_ms")
    return joined.withColumn("images_per_s", F.round(throughput(F.col("batch"), scope), 1))
