"""Average precision of a stream of whole images.

Every image is matched once, in the micro-batch that brings it, for all overlap thresholds and area ranges. What a
detection adds to the precision curves is its place in the score order and its lane masks. These rows are the state: per
class and part (a hash of the image, so that a class is never one key), kept as runs sorted by score. A new run is merged
with the run of its own size, the result with the next larger one, and so on, so each row is rewritten a number of times
that grows with the logarithm of the rows. Detections that count in no lane are not kept.

The statistics so far are a batch query over the state in the stream's checkpoint, at any time between two runs of the
stream. State and offsets are committed together, so a batch that is replayed after a failure counts once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from gridmark import scale
from gridmark.operators import average_precision as ap
from gridmark.operators import matching

# State keys per class.
PARTS = 64
# Rows of the smallest run, and of the largest that is merged again.
SHORT, LONG = 1_024, 1 << 21
_ROW = np.dtype([("score", "<f8"), ("image_id", "<i8"), ("rank", "<i4"), ("tp_mask", "<i8"), ("ignore_mask", "<i8")])
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(rows: np.ndarray) -> np.ndarray:
    """Rows by falling score (NaN last), image and rank."""
    return rows[np.lexsort((rows["rank"], rows["image_id"], -rows["score"], np.isnan(rows["score"])))]


def level_of(rows: int) -> int:
    return max(0, (rows // SHORT).bit_length())


class CurveRuns(StatefulProcessor):
    """Keeps the sorted runs and the ground-truth counts of a class and part."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "place bigint", "run binary")
        self.truth = handle.getValueState("truth", "counts array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh, counts = [], None
        for batch in rows:
            heads = batch["counts"] != ""
            for text in batch.loc[heads, "counts"]:
                own = np.array(text.split(","), np.int64)
                counts = own if counts is None else counts + own
            found = batch[~heads]
            part = np.empty(len(found), _ROW)
            for name in _ROW.names:
                part[name] = found[name].to_numpy()
            fresh.append(part)
        if counts is not None:
            before = np.array(self.truth.get()[0]) if self.truth.exists() else 0
            self.truth.update(([int(n) for n in before + counts],))
        run = in_order(np.concatenate(fresh)) if fresh else np.empty(0, _ROW)
        added = len(run)
        if added:
            self._insert(run)
        yield pd.DataFrame({"label": [key[0]], "part": [key[1]], "added": [added]})

    def _insert(self, run: np.ndarray) -> None:
        while len(run) < LONG and self.runs.containsKey((level_of(len(run)),)):
            level = (level_of(len(run)),)
            other = np.frombuffer(self.runs.getValue(level)[0], _ROW)
            self.runs.removeKey(level)
            run = in_order(np.concatenate([other, run]))
        place = level_of(len(run))
        # Long runs are final and numbered.
        while len(run) >= LONG and self.runs.containsKey((place,)):
            place += 1
        self.runs.updateValue((place,), (run.tobytes(),))

    def close(self) -> None:
        pass


def _curve_rows(images: DataFrame, lanes: matching.Lanes, last_cap: int, parts: int) -> DataFrame:
    """Detections that count in some lane, and one row with ground-truth counts for each image and class."""
    groups = matching.image_groups(images, lanes, last_cap)
    part = F.pmod(F.xxhash64("image_id"), F.lit(parts)).alias("part")
    step = len(lanes.thresholds)
    # A ground truth counts in all thresholds of an area range or in none.
    inside = [f"CAST(size(filter(gts, g -> getbit(g.regular, {a * step}) = 1)) AS STRING)" for a in range(len(lanes.areas))]
    heads = groups.select(
        "label", part, "image_id", F.lit(-1).alias("rank"), F.lit(0.0).alias("score"),
        F.lit(0).cast("bigint").alias("tp_mask"), F.lit(0).cast("bigint").alias("ignore_mask"),
        F.expr(f"concat_ws(',', {', '.join(inside)})").alias("counts"),
    )
    found = matching.match_groups(groups, lanes).filter(f"tp_mask <> 0L OR ignore_mask <> {lanes.every}L")
    names = ["image_id", F.col("rank").cast("int").alias("rank"), "score", "tp_mask", "ignore_mask"]
    return found.select("label", part, *names, F.lit("").alias("counts")).unionByName(heads)


def precision_stream(
    images: DataFrame,
    checkpoint: str,
    *,
    iou_grid: Sequence[float] = ap.IOU_GRID,
    area_names: Sequence[str] = tuple(matching.AREA_RANGES),
    max_dets: Sequence[int] = ap.BOX_MAX_DETS,
    parts: int = PARTS,
) -> DataStreamWriter:
    """Writer that matches a stream of whole images and keeps its curves below *checkpoint*.

    The session's state store provider must be the one with column families: see :func:`use_rocksdb`.
    """
    lanes = matching.coco_lanes(iou_grid, area_names)
    rows = _curve_rows(images, lanes, max(max_dets), parts)
    kept = rows.groupBy("label", "part").transformWithStateInPandas(
        CurveRuns(), "label bigint, part bigint, added bigint", "Update", "None"
    )
    return kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for label, run in zip(batch["label"], batch["run"], strict=True):
            rows = np.frombuffer(run, _ROW)
            for at in range(0, len(rows), 1 << 16):
                some = rows[at : at + (1 << 16)]
                yield pd.DataFrame({"label": label} | {name: some[name] for name in _ROW.names})


def precision_so_far(
    spark: SparkSession,
    checkpoint: str,
    *,
    iou_grid: Sequence[float] = ap.IOU_GRID,
    area_names: Sequence[str] = tuple(matching.AREA_RANGES),
    max_dets: Sequence[int] = ap.BOX_MAX_DETS,
    recall_grid: Sequence[float] = ap.RECALL_GRID,
) -> ap.Evaluation:
    """The evaluation of all images that the stream has taken in; same parameters as the stream's."""
    lanes = matching.coco_lanes(iou_grid, area_names)

    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    runs = state("runs").select("key.label", F.col("user_map_value.run").alias("run"))
    schema = "label bigint, score double, image_id bigint, rank int, tp_mask bigint, ignore_mask bigint"
    # A run is one value; dealing them out first lets all cores unpack.
    scored = runs.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_unpacked, schema)
    each = state("truth").select("key.label", F.posexplode("value.counts").alias("area", "n"))
    summed = each.groupBy("label", "area").agg(F.sum("n").alias("n"))
    counts = summed.groupBy("label").agg(F.expr("transform(array_sort(collect_list(struct(area, n))), c -> c.n) AS counts"))
    return ap.accumulate(scale.stored(scored, "curve-rows"), counts, lanes, max_dets, recall_grid)
