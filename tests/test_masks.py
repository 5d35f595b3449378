import random

import pytest
from pyspark.sql import functions as F

from gridmark.operators import masks as mk

RUNS = "image_id long, instance_id long, label long, run_start long, run_end long, height int"


def random_masks(seed, images=4, per_image=9):
    """Masks as pixel sets: blobs of random runs, some over several columns, in images of different heights."""
    draw, masks = random.Random(seed), {}
    heights = {i: draw.choice([7, 30, 300]) for i in range(images)}
    for image, height in heights.items():
        for instance in range(per_image):
            pixels = set()
            start = draw.randrange(40 * height)
            for _ in range(draw.randrange(1, 6)):
                start += draw.randrange(1, 2 * height)
                pixels.update(range(start, start + draw.choice([1, 3, height // 2 + 1, 2 * height + 3])))
            masks[image, instance, draw.randrange(2)] = pixels
    return masks, heights


def run_rows(masks, heights, split=False):
    rows = []
    for (image, instance, label), pixels in masks.items():
        start = None
        for p in sorted(pixels):
            if start is None or p != last + 1 or (split and p % 5 == 0):  # split: runs that touch
                if start is not None:
                    rows.append((image, instance, label, start, last + 1, heights[image]))
                start = p
            last = p
        rows += [(image, instance, label, start, last + 1, heights[image]), (image, instance, label, 3, 3, heights[image])]
    return rows


@pytest.mark.parametrize("tile", [mk.TILE, 5])
def test_overlaps_equal_pixel_sets(spark, monkeypatch, tile):
    monkeypatch.setattr(mk, "TILE", tile)
    left, heights = random_masks(1)
    right = {k: v for k, v in random_masks(2)[0].items()}
    a = spark.createDataFrame(run_rows(left, heights, split=True), RUNS)
    b = spark.createDataFrame(run_rows(right, heights), RUNS)
    want = {}
    for (image, i, label), p in left.items():
        for (other, j, kind), q in right.items():
            if (image, label) == (other, kind) and p & q:
                want[image, label, i, j] = (len(p), len(q), len(p & q), len(p | q), len(p & q) / len(p | q))
    packed = [mk.pack_masks(side, F.col("height")) for side in (a, b)]
    for sides in ((a, b, None), (a, b, F.col("height")), (*packed, None), (packed[0], b, F.col("height"))):
        got = mk.mask_overlaps(*sides).collect()
        rows = {(r.image_id, r.label, r.left_id, r.right_id): (r.left_area, r.right_area, r.intersection, r.union, r.iou) for r in got}
        assert len(rows) == len(got) and rows == want


def test_packed_masks_have_tight_boxes_and_areas(spark):
    masks, heights = random_masks(3)
    runs = spark.createDataFrame(run_rows(masks, heights), RUNS)
    got = {(r.image_id, r.instance_id, r.label): r for r in mk.pack_masks(runs, F.col("height")).collect()}
    assert got.keys() == masks.keys()
    for key, pixels in masks.items():
        h, r = heights[key[0]], got[key]
        columns, lines = [p // h for p in pixels], [p % h for p in pixels]
        assert r.area == len(pixels)
        wrapped = any(p % h == h - 1 and p + 1 in pixels for p in pixels)
        box = (min(columns), 0 if wrapped else min(lines), max(columns) + 1, h if wrapped else max(lines) + 1)
        assert (r.x1, r.y1, r.x2, r.y2) == box
        assert r.starts == [p for p in sorted(pixels) if p - 1 not in pixels]
        assert r.ends == [p + 1 for p in sorted(pixels) if p + 1 not in pixels]


def test_rectangles_pack_alike(spark):
    rows = [(1, 0, 0, 2, 3, 9, 20, 25), (1, 1, 0, 0, 0, 1, 1, 25), (1, 2, 0, 4, 4, 4, 9, 25), (2, 0, 1, 5, 0, 8, 30, 30)]
    boxes = spark.createDataFrame(rows, "image_id long, instance_id long, label long, x1 long, y1 long, x2 long, y2 long, height int")
    direct = mk.rectangle_masks(boxes, F.col("height"))
    by_runs = mk.pack_masks(mk.rectangle_runs(boxes, F.col("height")).join(boxes.select("image_id", "instance_id", "label", "height"), ["image_id", "instance_id", "label"]), F.col("height"))
    merged = {tuple(r)[:3]: sorted(p for a, b in zip(r.starts, r.ends, strict=True) for p in range(a, b)) for r in direct.collect()}
    again = {tuple(r)[:3]: sorted(p for a, b in zip(r.starts, r.ends, strict=True) for p in range(a, b)) for r in by_runs.collect()}
    assert merged == again and len(merged) == 3
    areas = {(r.image_id, r.instance_id): r.area for r in mk.mask_areas(direct).collect()}
    assert areas == {(1, 0): 119, (1, 1): 1, (2, 0): 90}
    assert mk.mask_overlaps(direct.limit(0), by_runs).collect() == []


def test_matching_pairs_of_crowds(spark):
    boxes = "image_id long, instance_id long, label long, x1 long, y1 long, x2 long, y2 long"
    found = mk.rectangle_masks(spark.createDataFrame([(1, 7, 0, 0, 0, 10, 10)], boxes), F.lit(50))
    truth = mk.rectangle_masks(spark.createDataFrame([(1, 0, 0, 5, 0, 25, 20), (1, 1, 0, 0, 0, 10, 5)], boxes), F.lit(50))
    crowds = spark.createDataFrame([(1, 0, 0)], "image_id long, gt_idx long, label long")
    got = {r.gt_idx: r.overlap for r in mk.matching_pairs(found, truth, crowds).collect()}
    assert got == {0: 0.5, 1: 0.5}
    assert {r.gt_idx: r.overlap for r in mk.matching_pairs(found, truth).collect()} == {0: 50 / 450, 1: 0.5}


def test_run_lengths_read_back_to_the_same_runs(spark):
    masks, heights = random_masks(5)
    runs = spark.createDataFrame(run_rows(masks, heights), RUNS).filter("run_end > run_start")
    lengths = mk.run_lengths(runs.withColumn("height", F.col("height") * 100), F.col("height") * 100)
    keys = ["image_id", "label", "instance_id"]
    counts = lengths.groupBy(*keys).agg(F.expr("transform(array_sort(collect_list(struct(position, length))), r -> r.length) AS counts"))
    columns = [*keys, "run_start", "run_end"]
    again = mk.counted_runs(counts).select(columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, runs.select(columns).collect()))


def test_run_lengths_as_json_with_reasons(spark):
    texts = {
        0: '{"counts":[2,3,0,1],"size":[2,3]}', 1: ' {"size":[2,3],"counts":[6]}', 2: '{"counts":"ab5","size":[2,3]}', 3: '{"counts":[1,-1,6],"size":[2,3]}',
        4: '{"counts":[1,1],"size":[2,3]}', 5: '{"size":[2,3]}', 6: '{"counts":[0],"size":[0,3]}', 7: "[[1.0,2.0]]", 8: None, 9: '{"counts":[1,1.5],"size":[1,2]}',
        10: '{"counts":[1,5]}', 11: '{"counts":[],"size":[0,0]}', 12: '{"counts":[null,6],"size":[2,3]}',
    }
    rows = spark.createDataFrame([(1, 0, i, t) for i, t in texts.items()], "image_id long, label long, instance_id long, segmentation string")
    got = mk.read_run_lengths(rows)
    reasons = {r.instance_id: r.reason for r in got.collect()}
    no_list = "counts are no list of whole numbers"
    assert reasons == {0: None, 1: None, 2: no_list, 3: "negative count", 4: "counts do not fill the size", 5: "no counts", 6: None, 9: no_list,
                       10: "no size", 11: None, 12: no_list}
    runs = mk.counted_runs(got.filter("reason IS NULL"))
    assert sorted((r.instance_id, r.run_start, r.run_end) for r in runs.collect()) == [(0, 2, 5), (0, 5, 6)]
    assert [(r.run_start, r.run_end) for r in mk.merge_runs(runs).collect()] == [(2, 6)]
