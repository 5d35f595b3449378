import json

from pyspark.sql import functions as F

from gridmark.operators import masks as mk
from gridmark.sources import coco
from tests.test_masks import RUNS, random_masks, run_rows

KEYS = ["image_id", "label", "instance_id"]


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def _pixels(counts):
    at, pixels = 0, set()
    for n, length in enumerate(counts):
        pixels |= set(range(at, at + length)) if n % 2 else set()
        at += length
    return pixels


def test_counted_runs_stay_in_their_row(spark):
    rows = [(1, 0, 0, [2, 3, 0, 1]), (1, 0, 1, []), (1, 0, 2, None), (None, 0, 3, [0, 2]), (1, 1, 4, [5, 0, 1, 2, 9]), (1, 1, 5, [4])]
    runs = mk.counted_runs(spark.createDataFrame(rows, "image_id long, label long, instance_id long, counts array<long>"))
    assert "Window" not in _plan(runs) and "Aggregate" not in _plan(runs)
    got = sorted((r.instance_id, r.run_start, r.run_end) for r in runs.collect())
    assert got == [(0, 2, 5), (0, 5, 6), (3, 0, 2), (4, 6, 8)]


def test_lengths_of_packed_masks_need_no_shuffle(spark):
    masks, heights = random_masks(8)
    runs = spark.createDataFrame(run_rows(masks, heights, split=True), RUNS)
    packed = mk.pack_masks(runs, F.col("height"))
    boxes = spark.createDataFrame([(1, 0, 0, 2, 3, 4, 9), (1, 0, 1, 0, 0, 3, 5), (1, 0, 2, 4, 4, 4, 9), (None, 0, 3, 0, 0, 1, 1)],
                                  "image_id long, label long, instance_id long, x1 long, y1 long, x2 long, y2 long")
    rectangles = mk.run_lengths(mk.rectangle_runs(boxes, F.lit(5), packed=True), F.lit(20), listed=True)
    assert not any(word in _plan(rectangles) for word in ("Window", "Aggregate", "Join"))
    # Columns that fill the height touch, and so do those that reach beyond it.
    assert {r.instance_id: r.counts for r in rectangles.collect()} == {0: [13, 11], 1: [0, 15, 5]}
    for form in (runs, packed):
        lengths = mk.run_lengths(form, F.lit(100_000), listed=True).collect()
        assert {(r.image_id, r.instance_id, r.label): _pixels(r.counts) for r in lengths} == masks
        assert all(sum(r.counts) == 100_000 and 0 not in r.counts[1:] for r in lengths)
    rows = mk.run_lengths(runs, F.lit(100_000)).groupBy(*KEYS).agg(F.sum("length").alias("n"), F.max("position").alias("p"))
    assert sorted((tuple(r)[:3], r.n, r.p + 1) for r in rows.collect()) == sorted(((r.image_id, r.label, r.instance_id), 100_000, len(r.counts)) for r in lengths)


def test_records_take_listed_lengths(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 1, 0, 2, 3, 4, 7), (1, 1, 1, 0, 0, 3, 5)], "image_id long, label long, instance_id long, x1 long, y1 long, x2 long, y2 long")
    detections = spark.createDataFrame([(1, 1, 0, 0.5, 10, 5), (1, 1, 1, 0.25, 10, 5)], "image_id long, label long, det_idx long, score double, height int, width int")
    categories = spark.createDataFrame([(1, "a"), (4, "b")], "category_id long, name string")
    space = spark.createDataFrame([(0, 1, "a"), (1, 4, "b")], "label long, category_id long, name string")
    packed = mk.run_lengths(mk.rectangle_runs(boxes, F.lit(10), packed=True), F.lit(50), listed=True)
    rows = mk.run_lengths(mk.rectangle_runs(boxes, F.lit(10)), F.lit(50))
    records = [sorted(map(str, coco.mask_records(detections, lengths, categories, space).collect())) for lengths in (packed, rows)]
    assert records[0] == records[1] and len(records[0]) == 2
    coco.write_records(coco.mask_records(detections, packed, categories, space), str(tmp_path / "r"), "gzip")
    assert len(list((tmp_path / "r").glob("*.json.gz"))) >= 1
    counts = {json.dumps(list(r.segmentation.counts)) for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert counts == {"[23, 4, 6, 4, 13]", "[0, 5, 5, 5, 5, 5, 25]"}
