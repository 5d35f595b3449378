import math
import os
import random

import pytest
from pyspark.sql import functions as F

from gridmark import scale
from gridmark.operators import average_precision as ap
from gridmark.operators import keypoints as kp
from gridmark.operators import matching as m
from tests import oracles
from tests.test_matching import frames, random_case


def masks_of(rows):
    return sorted((r.image_id, r.label, r.det_idx, r.rank, r.tp_mask, r.ignore_mask) for r in rows.collect())


@pytest.mark.parametrize("in_turn", [0, 60, 100_000])
@pytest.mark.parametrize("cap", [None, 7])
def test_rounds_turns_and_fold_agree(spark, monkeypatch, in_turn, cap):
    monkeypatch.setattr(m, "IN_TURN", in_turn)
    dets, gts = random_case(31, images=2, per_image=40, canvas=25)
    d, g = frames(spark, dets, gts)
    lanes = m.coco_lanes((0.3, 0.6, 0.9), ("all", "small"))
    folded = masks_of(m.match_lanes(d, g, lanes, max_dets=cap))
    assert masks_of(m.match_lanes(d, g, lanes, max_dets=cap, group_row_limit=5)) == folded
    pairs = m.large_group_pairs(*(frame for frame in (m._detection_columns(d, lanes, m._CORNERS), m._truth_columns(g, lanes, m._CORNERS))), lanes)
    pairs = pairs.select("image_id", "label", "det_idx", "gt_idx", "overlap")
    with_pairs = masks_of(m.match_lanes(d, g, lanes, pairs, max_dets=cap))
    assert masks_of(m.match_lanes(d, g, lanes, pairs, max_dets=cap, group_row_limit=5)) == with_pairs


def chain(spark, rivals):
    """Detection i likes ground truth i - 1 best and i next, so each waits for the one before it."""
    dets = [dict(image_id=1, det_idx=i, label=0, score=1 - i / (2 * rivals), x1=10.0 * i - 1, y1=0.0, x2=10.0 * i + 19, y2=20.0) for i in range(rivals)]
    gts = [dict(image_id=1, gt_idx=i, label=0, x1=10.0 * i, y1=0.0, x2=10.0 * i + 20, y2=20.0, area=400.0, iscrowd=False) for i in range(-1, rivals)]
    for e in gts:
        e["gt_idx"] += 1
        e["x1"], e["x2"] = e["x1"] + 3, e["x2"] + 3
    return frames(spark, dets, gts)


def count_rounds(monkeypatch):
    rounds, carried, real = [], [], m._round

    def counted(wishes):
        carried.append(wishes.count())
        rounds.append(1)
        return real(wishes)

    monkeypatch.setattr(m, "_round", counted)
    return rounds, carried


def test_a_chain_of_rivals_takes_few_rounds(spark, monkeypatch):
    rounds, _ = count_rounds(monkeypatch)
    d, g = chain(spark, 5000)
    rows = m.match_greedy(d, g, 0.3, group_row_limit=100)
    assert rows.filter("is_tp").count() == 5000 and len(rounds) == 0


def test_work_falls_from_round_to_round_and_copies_go(spark, monkeypatch):
    monkeypatch.setattr(m, "IN_TURN", 0)
    rounds, carried = count_rounds(monkeypatch)
    folder = scale.prepare_checkpoints(spark).removeprefix("file:")
    before = {f for f in os.listdir(folder) if f.startswith("wishes")}
    d, g = chain(spark, 12)
    rows = m.match_greedy(d, g, 0.3, group_row_limit=5)
    got = {(r.image_id, r.label, r.det_idx): "tp" if r.is_tp else "ignored" if r.is_ignored else "fp" for r in rows.collect()}
    dets, gts = ([r.asDict() for r in side.collect()] for side in (d, g))
    assert got == oracles.greedy(dets, gts, 0.3)
    assert all(a > b for a, b in zip(carried, carried[1:], strict=False)) and len(rounds) <= 12
    assert {f for f in os.listdir(folder) if f.startswith("wishes")} == before


def test_ids_may_be_text(spark):
    dets, gts = random_case(2, images=2)
    d, g = (f.withColumns({"image_id": F.concat(F.lit("i"), "image_id"), "label": F.concat(F.lit("c"), "label")}) for f in frames(spark, dets, gts))
    lanes = m.coco_lanes((0.5,))
    assert masks_of(m.match_lanes(d, g, lanes, group_row_limit=3)) == masks_of(m.match_lanes(d, g, lanes))


def test_inputs_are_read_once(spark, tmp_path):
    dets, gts = random_case(6, images=5)
    sides = []
    for name, frame in zip(("d", "g"), frames(spark, dets, gts), strict=True):
        frame.write.parquet(str(tmp_path / name))
        sides.append(spark.read.parquet(str(tmp_path / name)))
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    d, g = (side.mapInPandas(touch, side.schema) for side in sides)
    for limit in (2_000, 3):
        start = seen.value
        m.match_greedy(d, g, group_row_limit=limit).count()
        assert seen.value - start == len(dets) + len(gts)


def similar(found, truth, sigmas):
    labelled = [v > 0 for v in truth["keypoints"][2::3]]
    w, h = truth["x2"] - truth["x1"], truth["y2"] - truth["y1"]
    total, n = 0.0, 0
    for i, seen in enumerate(labelled):
        if any(labelled) and not seen:
            continue
        x, y = found[3 * i], found[3 * i + 1]
        if any(labelled):
            dx, dy = x - truth["keypoints"][3 * i], y - truth["keypoints"][3 * i + 1]
        else:
            dx = max(0.0, truth["x1"] - w - x) + max(0.0, x - (truth["x1"] + 2 * w))
            dy = max(0.0, truth["y1"] - h - y) + max(0.0, y - (truth["y1"] + 2 * h))
        total, n = total + math.exp(-(dx * dx + dy * dy) / (2 * sigmas[i]) ** 2 / (truth["area"] + 2.0**-52) / 2), n + 1
    return total / n if n else 0.0


@pytest.mark.parametrize("points", [17, 3])
def test_similarity_in_the_fold_equals_pairs_and_formula(spark, points):
    draw = random.Random(points)
    truth, found = [], []
    for image in range(3):
        for i in range(8):
            x, y = draw.uniform(0, 50), draw.uniform(0, 50)
            box = dict(x1=x, y1=y, x2=x + draw.uniform(20, 120), y2=y + draw.uniform(20, 120))
            visible = 0 if i == 7 else 2
            keypoints = [v for _ in range(points) for v in (draw.uniform(x, x + 40), draw.uniform(y, y + 40), float(draw.choice([0, visible])))]
            truth.append(dict(image_id=image, gt_idx=i, label=1, area=(box["x2"] - x) * (box["y2"] - y), iscrowd=i == 3, keypoints=keypoints, num_keypoints=None, **box))
            for j in range(4):
                near = [v + draw.uniform(-4, 4) if k % 3 < 2 else v for k, v in enumerate(keypoints)]
                found.append(dict(image_id=image, det_idx=10 * i + j, label=1, score=draw.choice([0.1, 0.5, 0.9]), keypoints=near))
    t = spark.createDataFrame(truth, "image_id long, gt_idx long, label long, area double, iscrowd boolean, keypoints array<double>, num_keypoints int, x1 double, y1 double, x2 double, y2 double")
    f = spark.createDataFrame(found, "image_id long, det_idx long, label long, score double, keypoints array<double>")
    counts = spark.createDataFrame([(1, points)], "category_id long, k int")
    sigmas = kp.PERSON_SIGMAS if points == 17 else [kp.CUSTOM_SIGMA] * points
    by_id = {(r["image_id"], r["gt_idx"]): r for r in truth}
    points_of = {(r["image_id"], r["det_idx"]): r["keypoints"] for r in found}
    pairs = kp.similarity_pairs(f, t, counts).collect()
    assert len(pairs) == 3 * 8 * 32
    for r in pairs:
        want = similar(points_of[r.image_id, r.det_idx], by_id[r.image_id, r.gt_idx], sigmas)
        assert r.overlap == pytest.approx(want, abs=1e-12)
    whole = kp.evaluate_keypoints(f, t, counts)
    split = kp.evaluate_keypoints(f, t, counts, group_row_limit=5)
    for one, other in ((whole.precision, split.precision), (whole.recall, split.recall)):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert len(ap.summarize_keypoints(whole).collect()) == 10
