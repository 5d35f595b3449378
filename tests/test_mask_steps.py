"""Masks travel to each other as steps, and pairs share the pixels that sets of pixels share."""

import random

import numpy as np
import pyarrow as pa
import pytest

from gridmark.operators import masks as mk

KIND = pa.list_(pa.int64())


def _random_masks(draw, n, width, origin=0):
    masks = []
    for _ in range(n):
        borders = sorted(draw.sample(range(width), 2 * draw.randint(0, 6)))
        masks.append(([origin + v for v in borders[0::2]], [origin + v for v in borders[1::2]]))
    return masks


def _steps(masks):
    return mk._stepped(pa.array([m and m[0] for m in masks], KIND), pa.array([m and m[1] for m in masks], KIND))


@pytest.mark.parametrize("scale", [1, 10**6, 10**12, 10**16])
def test_pairs_share_what_their_pixels_share(scale):
    """Also where steps need wide numbers, and where a line of all pairs would be too long."""
    draw = random.Random(3)
    left, right = ([([s * scale for s in a], [e * scale for e in b]) for a, b in _random_masks(draw, 500, 40)] for _ in range(2))
    left[7] = right[9] = None
    got = mk._shared(_steps(left), _steps(right)).to_pylist()

    def pixels(mask):
        return set() if mask is None else {p for s, e in zip(*mask) for p in range(s // scale, e // scale)}

    assert got == [scale * len(pixels(a) & pixels(b)) for a, b in zip(left, right)] and sum(got) > 0


def test_steps_give_the_borders_back():
    draw = random.Random(4)
    masks = _random_masks(draw, 50, 60, origin=5) + [([3, 2**40], [9, 2**40 + 2**33])] + _random_masks(draw, 20, 60, origin=2**50)
    steps = _steps(masks)
    assert sum(len(w) > 0 for w in steps.field("wide").to_pylist()) == 1
    begin, end, row = mk._borders(steps)
    for n, (starts, ends) in enumerate(masks):
        assert begin[row == n].tolist() == starts and end[row == n].tolist() == ends
    assert mk._shared(steps[:0], steps[:0]).to_pylist() == []


def test_masks_travel_narrow(spark):
    """What is shuffled for a pair of masks is a narrow number for each border."""
    rows = [(1, 0, i, [n * 100 + 5 for n in range(40)], [n * 100 + 45 for n in range(40)], 1600, 0, 5, 40, 45) for i in range(3)]
    kinds = "image_id long, label long, instance_id long, starts array<long>, ends array<long>, area long, x1 long, y1 long, x2 long, y2 long"
    masks = spark.createDataFrame(rows, kinds)
    pairs = mk.mask_overlaps(masks, masks)
    assert {(r.left_id, r.right_id, r.intersection, r.union) for r in pairs.collect()} == {(i, j, 1600, 1600) for i in range(3) for j in range(3)}
    joined = pairs._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    assert "starts" not in joined[0] and np.iinfo(np.int32).max > 4005
