import random

import pytest
from pyspark.sql import functions as F

from gridmark.operators import matching as m
from gridmark.schemas import DETECTIONS, GROUND_TRUTH
from tests import oracles


def random_case(seed, images=3, labels=2, per_image=14, canvas=60, ties=True):
    rng = random.Random(seed)
    dets, gts = [], []
    for image in range(images):
        for i in range(per_image):
            x, y = rng.randrange(canvas), rng.randrange(canvas)
            w, h = rng.choice([8, 16, 20, 35, 110]), rng.choice([8, 16, 20, 35, 110])
            gts.append(
                dict(image_id=image, gt_idx=i, label=rng.randrange(labels), x1=float(x), y1=float(y), x2=float(x + w),
                     y2=float(y + h), area=float(w * h), iscrowd=rng.random() < 0.2)
            )
        for i in range(per_image):
            base = rng.choice(gts)
            dx, dy = rng.randrange(-3, 4), rng.randrange(-3, 4)
            score = rng.randrange(10) / 10 if ties else rng.random()
            dets.append(
                dict(image_id=image, det_idx=i, label=rng.randrange(labels), score=score, x1=base["x1"] + dx,
                     y1=base["y1"] + dy, x2=base["x2"] + dx, y2=base["y2"] + dy)
            )
    dets.append(dict(image_id=0, det_idx=99, label=70, score=0.5, x1=0.0, y1=0.0, x2=5.0, y2=5.0))
    gts.append(dict(image_id=0, gt_idx=99, label=71, x1=0.0, y1=0.0, x2=5.0, y2=5.0, area=25.0, iscrowd=False))
    return dets, gts


def frames(spark, dets, gts):
    return spark.createDataFrame(dets, DETECTIONS), spark.createDataFrame(gts, GROUND_TRUTH)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [2_000, 4])
def test_greedy_equals_brute_force(spark, seed, limit):
    dets, gts = random_case(seed)
    d, g = frames(spark, dets, gts)
    rows = m.match_greedy(d.repartition(3), g, group_row_limit=limit).collect()
    got = {
        (r.image_id, r.label, r.det_idx): "tp" if r.is_tp else "ignored" if r.is_ignored else "fp" for r in rows
    }
    assert got == oracles.greedy(dets, gts, 0.5)


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("limit", [2_000, 4])
def test_lanes_equal_the_protocol(spark, seed, limit):
    dets, gts = random_case(seed)
    d, g = frames(spark, dets, gts)
    lanes = m.coco_lanes([0.5, 0.65, 0.9], ("all", "small", "medium"))
    rows = m.match_lanes(d, g, lanes, group_row_limit=limit).collect()
    assert len(rows) == len(dets)
    for a, (name, low, high) in enumerate(lanes.areas):
        for t, threshold in enumerate((0.5, 0.65, 0.9)):
            bit = 1 << lanes.lane(t, a)
            got = {
                (r.image_id, r.label, r.det_idx): (bool(r.tp_mask & bit), bool(r.ignore_mask & bit)) for r in rows
            }
            assert got == oracles.protocol_match(dets, gts, threshold, (low, high)), (name, threshold)


def test_one_very_large_group(spark):
    """A single image and class far above the limit goes through the rounds and still matches greedily."""
    dets, gts = random_case(9, images=1, labels=1, per_image=150, canvas=200, ties=False)
    d, g = frames(spark, dets, gts)
    rows = m.match_greedy(d, g, group_row_limit=20).collect()
    got = {(r.image_id, r.label, r.det_idx): "tp" if r.is_tp else "ignored" if r.is_ignored else "fp" for r in rows}
    assert got == oracles.greedy(dets, gts, 0.5)


def test_tie_rules(spark):
    box = dict(x1=0.0, y1=0.0, x2=10.0, y2=10.0)
    gts = [dict(image_id=1, gt_idx=0, label=1, area=100.0, iscrowd=False, **box)]
    near = [dict(image_id=1, det_idx=i, label=1, score=s, **box) for i, s in enumerate([0.9, 0.9 + 1e-12, float("nan")])]
    d, g = frames(spark, near, gts)
    winners = [r.det_idx for r in m.match_greedy(d, g).filter("is_tp").collect()]
    assert winners == [1]
    tied = [dict(r, score=0.5) for r in near]
    d, g = frames(spark, tied, gts)
    assert [r.det_idx for r in m.match_greedy(d, g).filter("is_tp").collect()] == [0]


def test_crowd_never_counts(spark):
    box = dict(x1=0.0, y1=0.0, x2=10.0, y2=10.0)
    gts = [dict(image_id=1, gt_idx=0, label=1, area=100.0, iscrowd=True, **box)]
    d, g = frames(spark, [dict(image_id=1, det_idx=0, label=1, score=0.9, **box)], gts)
    row = m.match_greedy(d, g).first()
    assert (row.is_tp, row.is_ignored) == (False, True)
    assert m.ground_truth_counts(g, d).first().total_gt == 0


def test_rank_is_stable_and_puts_nan_last(spark):
    rows = [dict(image_id=1, det_idx=i, label=1, score=s, x1=0.0, y1=0.0, x2=1.0, y2=1.0)
            for i, s in enumerate([float("nan"), 0.2, 0.7, 0.2])]
    ranked = m.rank_detections(spark.createDataFrame(rows, DETECTIONS)).orderBy("rank").collect()
    assert [r.det_idx for r in ranked] == [2, 1, 3, 0]
    assert m.rank_detections(spark.createDataFrame(rows, DETECTIONS), 2).count() == 2


def test_overlap_pairs_stay_inside_image_and_class(spark):
    dets, gts = random_case(5)
    d, g = frames(spark, dets, gts)
    pairs = m.overlap_pairs(d, g, 0.3).collect()
    expected = sum(
        oracles.iou(oracles.box_of(a), oracles.box_of(b)) >= 0.3
        for a in dets for b in gts if (a["image_id"], a["label"]) == (b["image_id"], b["label"])
    )
    assert len(pairs) == expected
    assert "CartesianProduct" not in m.overlap_pairs(d, g, 0.3)._jdf.queryExecution().toString()
    assert d.filter(F.col("score").isNull()).isEmpty()
