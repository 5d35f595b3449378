"""Average precision and recall by the published detection-evaluation protocol.

Matching runs once for all thresholds and area ranges (see ``matching``) and marks a detection's outcome in each lane
with one bit. The precision curve is one ordered pass over those masks: detections are never copied per lane, and only
the maxima per recall bin leave the pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark import scale
from gridmark.functions import boxes as bx
from gridmark.operators import matching

# Overlap thresholds 0.50, 0.55 ... 0.95 and recall levels 0.00, 0.01 ... 1.00, evenly spaced.
IOU_GRID = tuple(float(v) for v in np.linspace(0.5, 0.95, 10))
RECALL_GRID = tuple(float(v) for v in np.linspace(0.0, 1.0, 101))
BOX_MAX_DETS = (1, 10, 100)
KEYPOINT_MAX_DETS = (20,)
UNDEFINED = -1.0


@dataclass(frozen=True)
class Evaluation:
    """Long tables of one run: ``precision`` per recall level and ``recall`` per detection cap."""

    precision: DataFrame  # label, iou, area_range, recall_level, precision (null when undefined)
    recall: DataFrame  # label, iou, area_range, max_dets, recall (null when undefined)


def truth_areas(ground_truth: DataFrame, mask_area: Column | None = None) -> DataFrame:
    """Area used for size ranges: the stored one when positive, else the mask's, else the box's."""
    fallback = bx.area(bx.box())
    if mask_area is not None:
        fallback = F.coalesce(mask_area, fallback)
    stored = F.col("area") if "area" in ground_truth.columns else F.lit(None).cast("double")
    return ground_truth.withColumn("area", F.when(stored > 0, stored).otherwise(fallback))


def size_name(area: Column) -> Column:
    """Size class by the published limits, 32 and 96 pixels squared."""
    return F.when(area < 32.0**2, F.lit("small")).when(area < 96.0**2, F.lit("medium")).otherwise(F.lit("large"))


def truth_counts(ground_truth: DataFrame, lanes: matching.Lanes) -> DataFrame:
    """``label, counts``: countable ground truths per class, one number for each area range; crowds keep zero rows."""
    inside = [f"count_if(NOT iscrowd AND area >= {low!r}D AND area <= {high!r}D)" for _, low, high in lanes.areas]
    return ground_truth.groupBy("label").agg(F.expr(f"array({', '.join(inside)}) AS counts"))


def positives(counts: DataFrame, lanes: matching.Lanes) -> DataFrame:
    """The counts as rows ``label, area_range, positives``."""
    named = [F.struct(F.lit(a[0]).alias("area_range"), F.get("counts", F.lit(i)).alias("positives")) for i, a in enumerate(lanes.areas)]
    return counts.select("label", F.inline(F.array(*named)))


_ORDER = ["isnan(score)", "score DESC", "image_id", "rank"]
_BIN_SCHEMA = "label bigint, lane int, bin int, best double, hits array<bigint>"


def _positive_arrays(counts: DataFrame, lanes: matching.Lanes) -> DataFrame:
    return counts.selectExpr("label", f"flatten(transform(counts, c -> array_repeat(c, {len(lanes.thresholds)}))) AS positives")


def _lane_bits(masks: pd.Series, lane_count: int) -> np.ndarray:
    """Lanes x rows matrix of the bits of 64-bit masks."""
    octets = masks.to_numpy("<i8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(np.unpackbits(octets, axis=1, bitorder="little", count=lane_count).T)


def _slice_totals(slim: DataFrame, lane_count: int) -> DataFrame:
    """Per class and slice: true positives of every lane, then counted rows of every lane, as one array.

    Summed over bit matrices batch by batch; a generated aggregate over 2 x lanes columns is too large to be compiled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = np.arange(2 * lane_count)
        for batch in batches:
            for (label, part), rows in batch.groupby(["label", "_slice"]):
                hit = _lane_bits(rows["tp_mask"], lane_count).sum(axis=1, dtype=np.int64)
                counted = len(rows) - _lane_bits(rows["ignore_mask"], lane_count).sum(axis=1, dtype=np.int64)
                yield pd.DataFrame({"label": label, "_slice": part, "n": numbers, "own": np.concatenate((hit, counted))})

    columns = slim.select("label", "_slice", "tp_mask", "ignore_mask")
    return columns.mapInPandas(run, "label bigint, _slice int, n int, own bigint").groupBy("label", "_slice", "n").agg(
        F.sum("own").alias("own")
    )


def _bin_batches(lane_count: int, caps: Sequence[int], levels: Sequence[float]):
    """Arrow-batch step over rows in score order. A header row opens a stretch of one class with its ground-truth
    counts and the running counts before it; each following row moves all lanes at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = np.asarray(levels)
        stretch: dict = {}

        def close() -> pd.DataFrame | None:
            if not stretch:
                return None
            lane, level = np.nonzero(stretch["best"] > 0)
            best = stretch["best"][lane, level]
            # Hits per cap are reported once per lane, with the lane's first bin.
            first = np.concatenate(([True], lane[1:] != lane[:-1])) if len(lane) else np.zeros(0, bool)
            none = np.zeros(len(caps), dtype=np.int64)
            hits = [stretch["hits"][number] if lead else none for number, lead in zip(lane, first)]
            return pd.DataFrame({"label": stretch["label"], "lane": lane, "bin": level, "best": best, "hits": hits})

        for batch in batches:
            opens = np.flatnonzero(batch["head"].notna().to_numpy())
            edges = np.unique(np.concatenate(([0], opens, [len(batch)])))
            for start, end in zip(edges[:-1], edges[1:]):
                part = batch.iloc[start:end]
                if start in opens:
                    done = close()
                    if done is not None and len(done):
                        yield done
                    numbers = np.array(part["head"].iloc[0].split(","), dtype=np.int64)
                    stretch = {
                        "label": part["label"].iloc[0],
                        "positives": np.maximum(numbers[:lane_count], 1),
                        "tp": numbers[lane_count : 2 * lane_count],
                        "seen": numbers[2 * lane_count :],
                        "best": np.zeros((lane_count, len(grid) + 1)),
                        "hits": np.zeros((lane_count, len(caps)), dtype=np.int64),
                    }
                    part = part.iloc[1:]
                # Classes without ground truth have no header: they are undefined and skipped.
                part = part[part["label"] == stretch["label"]] if stretch else part.iloc[:0]
                if not len(part):
                    continue
                hit = _lane_bits(part["tp_mask"], lane_count)
                counted = 1 - _lane_bits(part["ignore_mask"], lane_count)
                tp = stretch["tp"][:, None] + np.cumsum(hit, axis=1, dtype=np.int64)
                seen = stretch["seen"][:, None] + np.cumsum(counted, axis=1, dtype=np.int64)
                stretch["tp"], stretch["seen"] = tp[:, -1], seen[:, -1]
                rank = part["rank"].to_numpy(np.int64)
                for position, cap in enumerate(caps):
                    stretch["hits"][:, position] += hit[:, rank < cap].sum(axis=1, dtype=np.int64)
                lane, row = np.nonzero(hit)
                if not len(lane):
                    continue
                reached = tp[lane, row]
                level = np.searchsorted(grid, reached / stretch["positives"][lane], side="right")
                # Lanes ascend and recall only grows along a lane, so equal bins are neighbours.
                bins = lane * (len(grid) + 1) + level
                first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
                peaks = np.maximum.reduceat(reached / seen[lane, row], first)
                flat = stretch["best"].reshape(-1)
                flat[bins[first]] = np.maximum(flat[bins[first]], peaks)
        done = close()
        if done is not None and len(done):
            yield done

    return run


def precision_bins(
    scored: DataFrame,
    counts: DataFrame,
    lanes: matching.Lanes,
    max_dets: Sequence[int],
    recall_grid: Sequence[float] = RECALL_GRID,
) -> DataFrame:
    """Largest precision per class, lane and recall bin, and true positives per cap; *counts* are :func:`truth_counts`.

    Rows are read in order of class, score, image and rank in ranges of equal size: each starts from the counts of its
    class's ranges before it, so no task grows with a class. *scored* is read twice, to sample the ranges and to deal them
    out, so it should be a stored table, as matching returns it.
    """
    slim = scored.select("label", "image_id", "rank", "score", "tp_mask", "ignore_mask")
    positive = _positive_arrays(counts, lanes)
    count = len(lanes)
    keys = ["label", "_slice"]
    slim = scale.order_slices(slim, ["label"], _ORDER)
    # One row per class, range and counter; a window holds as many rows as there are slices.
    window = "OVER (PARTITION BY label, n ORDER BY _slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    before = _slice_totals(slim, count).selectExpr(*keys, "n", f"coalesce(sum(own) {window}, 0L) AS before")
    carried = "transform(array_sort(collect_list(named_struct('n', n, 'v', before))), c -> c.v) AS carried"
    heads = before.groupBy(*keys).agg(F.expr(carried)).join(positive, "label")
    # As text: the column is null on all other rows, and nested columns are converted to Python value by value.
    # Masks are zero there, not null: with nulls they would reach Python as doubles, which hold 53 lanes only.
    heads = heads.selectExpr(
        *keys, "0 AS _kind", "array_join(concat(positives, carried), ',') AS head", "0L AS tp_mask", "0L AS ignore_mask"
    )
    rows = slim.selectExpr("*", "1 AS _kind").unionByName(heads, allowMissingColumns=True)
    # A fixed number of partitions, so that small inputs are not merged into one Python worker.
    placed = rows.repartition(scale.slice_count(rows.sparkSession), *keys).sortWithinPartitions(*keys, "_kind", *[scale.sort_column(t) for t in _ORDER])
    bins = placed.select("label", "rank", "tp_mask", "ignore_mask", "head").mapInPandas(
        _bin_batches(count, tuple(max_dets), tuple(recall_grid)), _BIN_SCHEMA
    )
    named = bins.withColumns(lanes.names())
    return named.groupBy("label", "area_range", "iou", "bin").agg(
        F.max("best").alias("best"),
        *[F.expr(f"sum(hits[{i}]) AS hits{cap}") for i, cap in enumerate(max_dets)],
    )


def accumulate(
    scored: DataFrame,
    counts: DataFrame,
    lanes: matching.Lanes,
    max_dets: Sequence[int],
    recall_grid: Sequence[float] = RECALL_GRID,
) -> Evaluation:
    """Interpolated precision and final recall per class, threshold and area range; *counts* are :func:`truth_counts`.

    Precision at recall r is the largest precision at any recall >= r: a per-lane window of one row per recall level takes
    suffix maxima over the binned table, which holds at most classes x lanes x (levels + 1) rows. That table is materialised, so
    the matching behind it runs once however many summaries follow.
    """
    if list(recall_grid) != sorted(set(recall_grid)):
        raise ValueError("recall levels must ascend")
    # One row per class, used by several summaries; what it is counted from should be read once.
    counts = scale.stored(counts, "truth-counts")
    npig = positives(counts, lanes)
    frame = npig.select(
        "label",
        "area_range",
        "positives",
        F.explode(F.array(*[F.lit(t) for t in lanes.thresholds])).alias("iou"),
    )
    keys = ["label", "area_range", "iou"]
    binned = scale.cut_lineage(precision_bins(scored, counts, lanes, max_dets, recall_grid))
    levels = frame.select(
        "*", F.posexplode(F.array(*[F.lit(float(r)) for r in recall_grid])).alias("_position", "recall_level")
    ).withColumn("bin", F.col("_position") + 1)
    suffix = Window.partitionBy(*keys).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    defined = F.col("positives") > 0
    precisions = levels.join(binned.select(*keys, "bin", "best"), [*keys, "bin"], "left").select(
        *keys,
        "recall_level",
        F.when(defined, F.coalesce(F.max("best").over(suffix), F.lit(0.0))).alias("precision"),
    )
    hits = binned.groupBy(*keys).agg(*[F.sum(f"hits{cap}").alias(f"hits{cap}") for cap in max_dets])
    caps = F.array(
        *[F.struct(F.lit(cap).alias("max_dets"), F.coalesce(f"hits{cap}", F.lit(0)).alias("hits")) for cap in max_dets]
    )
    recalls = (
        frame.join(hits, keys, "left")
        .select(*keys, "positives", F.inline(caps))
        .select(
            *keys,
            "max_dets",
            F.when(defined, F.col("hits").cast("double") / F.greatest(F.col("positives"), F.lit(1)).cast("double")).alias(
                "recall"
            ),
        )
    )
    return Evaluation(precisions, recalls)


def evaluate(
    detections: DataFrame,
    ground_truth: DataFrame,
    *,
    iou_grid: Sequence[float] = IOU_GRID,
    area_names: Sequence[str] = ("all", "small", "medium", "large"),
    max_dets: Sequence[int] = BOX_MAX_DETS,
    recall_grid: Sequence[float] = RECALL_GRID,
    pairs: DataFrame | None = None,
    group_row_limit: int = scale.GROUP_ROW_LIMIT,
    parts: int = 1,
) -> Evaluation:
    """Full evaluation of one run. Ground truth without an ``area`` column uses its ``mask_area``, or else box areas;
    detections bring the area of their masks as ``area``.

    Classes that only appear in detections are kept and come out undefined. A grid too long for one pass is evaluated
    in several. With *parts*, images with given *pairs* are matched in so many parts one after the other.
    """
    passes = matching.lane_passes(iou_grid, area_names)
    if len(passes) > 1:
        options = {"area_names": area_names, "max_dets": max_dets, "recall_grid": recall_grid, "pairs": pairs, "group_row_limit": group_row_limit, "parts": parts}
        parts = [evaluate(detections, ground_truth, iou_grid=p, **options) for p in passes]
        return Evaluation(
            reduce(DataFrame.unionByName, [p.precision for p in parts]), reduce(DataFrame.unionByName, [p.recall for p in parts])
        )
    truth = truth_areas(ground_truth, F.col("mask_area") if "mask_area" in ground_truth.columns else None)
    lanes = matching.coco_lanes(iou_grid, area_names)
    scored = matching.match_lanes(detections, truth, lanes, pairs, max(max_dets), group_row_limit, parts=parts)
    # One row per class: against the ground truths themselves, the anti join would put all of a class into one task.
    counts = scale.stored(truth_counts(truth, lanes), "truth-counts")
    result = accumulate(scored, counts, lanes, max_dets, recall_grid)
    only_detected = scored.select("label").distinct().join(counts.select("label"), "label", "left_anti")
    blank = only_detected.select(
        "label",
        F.explode(F.array(*[F.lit(n) for n in area_names])).alias("area_range"),
        F.lit(None).cast("double").alias("_none"),
    ).select("*", F.explode(F.array(*[F.lit(t) for t in lanes.thresholds])).alias("iou"))
    keys = ["label", "area_range", "iou"]
    extra_precision = blank.select(
        *keys,
        F.explode(F.array(*[F.lit(float(r)) for r in recall_grid])).alias("recall_level"),
        F.col("_none").alias("precision"),
    )
    extra_recall = blank.select(
        *keys, F.explode(F.array(*[F.lit(m) for m in max_dets])).alias("max_dets"), F.col("_none").alias("recall")
    )
    return Evaluation(result.precision.unionByName(extra_precision), result.recall.unionByName(extra_recall))


def _or_undefined(value: Column) -> Column:
    return F.coalesce(value, F.lit(UNDEFINED))


def _near(threshold: float) -> Column:
    return F.abs(F.col("iou") - threshold) < 1e-9


def _statistics(result: Evaluation, ap_rows: list, ar_rows: list) -> DataFrame:
    """Both parts as one long table (statistic, value); an average over nothing is -1."""
    ap = result.precision.agg(
        *[_or_undefined(F.avg(F.when(condition, F.col("precision")))).alias(name) for name, condition in ap_rows]
    )
    ar = result.recall.agg(
        *[_or_undefined(F.avg(F.when(condition, F.col("recall")))).alias(name) for name, condition in ar_rows]
    )
    names = [[n for n, _ in ap_rows], [n for n, _ in ar_rows]]
    parts = [
        frame.select(F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in group])))
        for frame, group in zip((ap, ar), names)
    ]
    return parts[0].unionByName(parts[1])


def summarize_boxes(result: Evaluation, max_dets: Sequence[int] = BOX_MAX_DETS) -> DataFrame:
    """The box or mask statistics, 12 with three caps. Average precision uses the last cap, recall one row per cap and size."""
    caps = sorted(max_dets)
    last = caps[-1]
    whole = F.col("area_range") == "all"

    def sized(name: str) -> Column:
        return F.col("area_range") == name

    ap = [
        ("AP", whole),
        ("AP50", whole & _near(0.5)),
        ("AP75", whole & _near(0.75)),
        ("APs", sized("small")),
        ("APm", sized("medium")),
        ("APl", sized("large")),
    ]
    ar = [(f"AR{cap}", whole & (F.col("max_dets") == cap)) for cap in caps]
    ar += [(f"AR{n[0]}", sized(n) & (F.col("max_dets") == last)) for n in ("small", "medium", "large")]
    return _statistics(result, ap, ar)


def summarize_keypoints(result: Evaluation) -> DataFrame:
    """The 10 keypoint statistics, at the protocol's cap of 20."""
    whole = F.col("area_range") == "all"
    rules = [
        ("", whole),
        ("50", whole & _near(0.5)),
        ("75", whole & _near(0.75)),
        ("m", F.col("area_range") == "medium"),
        ("l", F.col("area_range") == "large"),
    ]
    return _statistics(result, [(f"AP{n}", c) for n, c in rules], [(f"AR{n}", c) for n, c in rules])


def per_class(result: Evaluation, last_cap: int = 100) -> DataFrame:
    """AP and AR of every class over all sizes at the last cap, -1 when undefined."""
    whole = F.col("area_range") == "all"
    ap = result.precision.filter(whole).groupBy("label").agg(_or_undefined(F.avg("precision")).alias("ap"))
    ar = (
        result.recall.filter(whole & (F.col("max_dets") == last_cap))
        .groupBy("label")
        .agg(_or_undefined(F.avg("recall")).alias("ar"))
    )
    return ap.join(ar, "label")


def per_class_report(classes: DataFrame, names: DataFrame, f1_rows: DataFrame) -> DataFrame:
    """Report rows: classes without ground truth are left out, a missing name is the id, missing F1 is NaN."""
    real = classes.filter(~((F.col("ap") < 0) & (F.isnan("ar") | (F.col("ar") < 0))))
    nan = F.lit(float("nan"))
    return (
        real.join(names.select("label", F.col("name").alias("_name")), "label", "left")
        .join(f1_rows.select("label", "f1", "precision", "recall"), "label", "left")
        .select(
            F.coalesce(F.col("_name"), F.col("label").cast("string")).alias("name"),
            "label",
            "ap",
            "ar",
            F.coalesce("f1", nan).alias("f1"),
            F.coalesce("precision", nan).alias("precision"),
            F.coalesce("recall", nan).alias("recall"),
        )
    )


def evaluate_subset(detections: DataFrame, ground_truth: DataFrame, subset: DataFrame, **options) -> DataFrame:
    """AP and AP50 on the chosen images. A run without detections reports 0, never the undefined value."""
    image_ids = subset.select("image_id")
    kept = detections.join(image_ids, "image_id", "left_semi")
    truth = ground_truth.join(image_ids, "image_id", "left_semi")
    stats = summarize_boxes(evaluate(kept, truth, **options))
    chosen = stats.filter(F.col("statistic").isin("AP", "AP50"))
    return chosen.withColumn("value", F.greatest(F.col("value"), F.lit(0.0)))
