import random

import pytest
from pyspark.sql import functions as F

from gridmark.operators import average_precision as ap
from gridmark.operators import keypoints as kp
from gridmark.operators import masks as mk
from gridmark.operators import matching as m
from gridmark.operators import sweep as sw
from gridmark.schemas import DETECTIONS, GROUND_TRUTH
from tests import oracles
from tests.test_matching import frames, random_case


@pytest.mark.parametrize("options", [{}, {"group_row_limit": 10}])
def test_average_precision_equals_the_protocol(spark, options):
    dets, gts = random_case(11, images=4, per_image=20)
    d, g = frames(spark, dets, gts)
    result = ap.evaluate(d, g, iou_grid=(0.5, 0.75), max_dets=(1, 5, 8), **options)
    precision, recall = result.precision.collect(), result.recall.collect()
    for label in (0, 1, 70, 71):
        for name, bounds in m.AREA_RANGES.items():
            for t in (0.5, 0.75):
                want, want_recall = oracles.average_precision(dets, gts, t, bounds, label, 8)
                rows = [r for r in precision if r.label == label and r.area_range == name and abs(r.iou - t) < 1e-9]
                got = [r.precision for r in sorted(rows, key=lambda r: r.recall_level)]
                last = [
                    r.recall for r in recall
                    if r.label == label and r.area_range == name and abs(r.iou - t) < 1e-9 and r.max_dets == 8
                ]
                assert got == (want if want is not None else [None] * 101)
                assert last == [want_recall]


def multiclass(spark):
    dets = [(0, 0, 3, 0.9, 0, 0, 10, 10), (0, 1, 17, 0.8, 20, 20, 28, 28), (1, 0, 42, 0.95, 0, 0, 10, 10),
            (2, 0, 17, 0.6, 0, 0, 10, 10), (2, 1, 17, 0.4, 50, 50, 60, 60)]
    gts = [(0, 0, 3, 0, 0, 10, 10), (0, 1, 17, 20, 20, 30, 30), (1, 0, 3, 5, 5, 15, 15), (2, 0, 17, 0, 0, 10, 10)]
    d = spark.createDataFrame([(a, b, c, float(s), *map(float, box)) for a, b, c, s, *box in dets], DETECTIONS)
    g = spark.createDataFrame([(a, b, c, *map(float, box), None, False) for a, b, c, *box in gts], GROUND_TRUTH)
    return d, g


def test_sentinels(spark):
    d, g = multiclass(spark)
    rows = {r.label: r for r in ap.per_class(ap.evaluate(d, g)).collect()}
    assert rows[42].ap == -1.0 and rows[42].ar == -1.0  # only predicted
    assert 0 < rows[3].ap < 1 and rows[3].ar == 0.5
    none = {r.label: r for r in ap.per_class(ap.evaluate(d.limit(0), g)).collect()}
    assert (none[3].ap, none[3].ar) == (0.0, 0.0)
    stats = ap.summarize_boxes(ap.evaluate(d.limit(0), g.limit(0))).collect()
    assert len(stats) == 12 and {r.value for r in stats} == {-1.0}


def test_sweep_small_case_and_nan(spark):
    rows = [(1, 0.9, True, False), (1, 0.4, False, False), (1, float("nan"), True, False), (1, 0.99, True, True)]
    matched = spark.createDataFrame(rows, "label long, score double, is_tp boolean, is_ignored boolean")
    counts = spark.createDataFrame([(1, 1), (2, 0)], "label long, total_gt long")
    got = {(r.label, r.threshold): (r.tp, r.fp) for r in sw.sweep_by_class(matched, counts, [0.5, 0.0]).collect()}
    assert got == {(1, 0.0): (1, 1), (1, 0.5): (1, 0), (2, 0.0): (0, 0), (2, 0.5): (0, 0)}
    best = sw.best_threshold(sw.macro_sweep(sw.sweep_by_class(matched, counts))).first()
    assert (round(best.threshold, 2), best.macro_f1) == (0.41, 1.0)


def test_sweep_equals_rescan(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(11) / 10, rng.random() < 0.5, rng.random() < 0.2) for _ in range(300)]
    matched = spark.createDataFrame(rows, "label long, score double, is_tp boolean, is_ignored boolean")
    counts = spark.createDataFrame([(i, 50) for i in range(3)], "label long, total_gt long")
    grid = [0.0, 0.3, 0.30000001, 0.7, 1.0]
    inclusive = {(r.label, r.threshold): (r.tp, r.fp) for r in sw.sweep_by_class(matched, counts, grid).collect()}
    strict = {(r.label, r.threshold): (r.tp, r.fp) for r in sw.strict_sweep_by_class(matched, counts, grid).collect()}
    for label in range(3):
        for t in grid:
            kept = [r for r in rows if r[0] == label and not r[3]]
            assert inclusive[label, t] == tuple(sum(r[1] >= t and r[2] == hit for r in kept) for hit in (True, False))
            assert strict[label, t] == tuple(sum(r[1] > t and r[2] == hit for r in kept) for hit in (True, False))


def test_result_does_not_depend_on_partitioning_or_adaptive_plans(spark):
    dets, gts = random_case(21)
    d, g = frames(spark, dets, gts)
    first = ap.summarize_boxes(ap.evaluate(d, g)).collect()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        second = ap.summarize_boxes(ap.evaluate(d.orderBy(F.rand(3)).repartition(7), g.repartition(2))).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Means are sums of many doubles, so only their last bits may depend on the order.
    assert {r.statistic: r.value for r in first} == pytest.approx({r.statistic: r.value for r in second}, abs=1e-12)


def person(offset=0.0):
    return [v for i in range(17) for v in (10.0 + 3 * i + offset, 20.0 + 2 * i + offset, 2.0)]


@pytest.mark.parametrize("offset, expected", [(0.0, 1.0), (500.0, 0.0)])
def test_keypoint_evaluation(spark, offset, expected):
    truth = spark.createDataFrame(
        [(1, 0, 1, 0.0, 0.0, 80.0, 80.0, 6400.0, False, person(), None)],
        "image_id long, gt_idx long, label long, x1 double, y1 double, x2 double, y2 double, area double, iscrowd boolean,"
        " keypoints array<double>, num_keypoints int",
    )
    found = spark.createDataFrame(
        [(1, 0, 1, 0.9, person(offset))], "image_id long, det_idx long, label long, score double, keypoints array<double>"
    )
    counts = spark.createDataFrame([(1, 17)], "category_id long, k int")
    stats = {r.statistic: r.value for r in ap.summarize_keypoints(kp.evaluate_keypoints(found, truth, counts)).collect()}
    assert stats["AP"] == pytest.approx(expected, abs=1e-9)
    assert stats["AR"] == pytest.approx(expected, abs=1e-9)


def test_mask_runs_and_polygons(spark):
    instances = spark.createDataFrame(
        [(1, 1, 0, [[2.0, 1.0, 6.0, 1.0, 6.0, 4.0, 2.0, 4.0], [0.0, 0.0, 1.0, 1.0]], 10, 10)],
        "image_id long, label long, instance_id long, polygons array<array<double>>, height int, width int",
    )
    runs = mk.polygon_runs(instances)
    assert mk.mask_areas(runs).first().area == 12
    box = mk.tight_boxes(runs, F.lit(10), exclusive_end=True).first()
    assert (box.x1, box.y1, box.x2, box.y2) == (2.0, 1.0, 6.0, 4.0)
    lengths = [r.length for r in mk.run_lengths(runs, F.lit(100)).orderBy("position").collect()]
    assert lengths == [21, 3, 7, 3, 7, 3, 7, 3, 46] and sum(lengths) == 100
    long_run = spark.createDataFrame([(1, 1, 0, 3, 9000)], "image_id long, label long, instance_id long, run_start long, run_end long")
    other = spark.createDataFrame([(1, 1, 5, 4000, 12000)], long_run.schema)
    row = mk.mask_overlaps(long_run, other).first()
    assert (row.intersection, row.union) == (5000, 11997)


def _filled(polygon, height, width):
    points = list(zip(polygon[0::2], polygon[1::2]))
    edges = list(zip(points, points[1:] + points[:1]))
    inside = set()
    for column in range(width):
        for row in range(height):
            x, y = column + 0.5, row + 0.5
            below = [y1 + (x - x1) * (y2 - y1) / (x2 - x1) <= y for (x1, y1), (x2, y2) in edges if (x1 <= x) != (x2 <= x)]
            if sum(below) % 2:
                inside.add(column * height + row)
    return inside


def test_polygons_fill_the_pixels_inside_them(spark):
    draw = random.Random(1)
    shapes = [[round(draw.uniform(-3, 23), 2) for _ in range(2 * draw.randint(3, 7))] for _ in range(30)]
    rows = [(1, 1, i, 20, 15, [p]) for i, p in enumerate(shapes)]
    kinds = "image_id long, label long, instance_id long, width int, height int, polygons array<array<double>>"
    got = {i: set() for i in range(len(shapes))}
    for r in mk.polygon_runs(spark.createDataFrame(rows, kinds)).collect():
        got[r.instance_id] |= set(range(r.run_start, r.run_end))
    assert got == {i: _filled(p, 15, 20) for i, p in enumerate(shapes)}


def test_long_grids_run_in_passes(spark):
    dets, gts = random_case(5, images=3, per_image=12)
    d, g = frames(spark, dets, gts)
    grid = [0.2 + 0.01 * i for i in range(70)]
    whole = ap.evaluate(d, g, iou_grid=grid, area_names=("all",), max_dets=(10,)).recall.collect()
    assert len({r.iou for r in whole}) == 70
    few = ap.evaluate(d, g, iou_grid=grid[60:62], area_names=("all",), max_dets=(10,)).recall.collect()
    assert len(few) == 8 and {str(r) for r in few} <= {str(r) for r in whole}


def test_ranks_are_limited_before_the_shuffle(spark):
    from gridmark.operators import annotations as an
    from gridmark.operators import decode as dc

    dets, gts = random_case(6, images=2, per_image=5)
    d, g = frames(spark, dets, gts)
    scored = d.withColumn("flat_idx", F.col("det_idx"))
    images = d.select("image_id").distinct()
    plans = (m.rank_detections(d, 3), dc.select_topk(scored.drop("det_idx"), 3), an.pad_targets(g, images, 3, ["gt_idx"]))
    for frame in plans:
        assert "WindowGroupLimit" in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [0, 2_000])
def test_thresholds_must_be_positive(spark, limit):
    d, g = frames(spark, *random_case(6, images=2, per_image=5))
    with pytest.raises(ValueError):
        m.match_greedy(d, g, 0.0, group_row_limit=limit)
    assert m.match_greedy(d, g, 1.0, group_row_limit=limit).count() == d.count()


def test_ground_truths_are_not_shuffled_by_category(spark):
    detections, truth = frames(spark, *random_case(5))
    points = F.array(*[F.col(c) for c in ("x1", "y1")], F.lit(2.0))
    detections, truth = (rows.withColumn("keypoints", points) for rows in (detections, truth.withColumn("area", F.lit(900.0))))
    counts = truth.groupBy(F.col("label").alias("category_id")).agg(F.lit(1).alias("k"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kp.truth_points(truth, counts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_classes_are_compared_without_the_ground_truths(spark, tmp_path):
    detections, truth = frames(spark, *random_case(6))
    truth.write.parquet(f"{tmp_path}/truth-rows")
    result = ap.evaluate(detections, spark.read.parquet(f"{tmp_path}/truth-rows"))
    assert not [f for rows in (result.precision, result.recall) for f in rows.inputFiles() if "truth-rows" in f]
