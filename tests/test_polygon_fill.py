"""Polygons of an instance are filled together, wherever they come from, and only the polygons are shuffled."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from gridmark.operators import masks as mk

KINDS = "image_id long, label long, instance_id long, width int, height int, polygons array<array<double>>"


def _filled(polygon, height, width):
    points = list(zip(polygon[0::2], polygon[1::2]))
    edges = list(zip(points, points[1:] + points[:1]))
    inside = set()
    for x in range(width):
        for y in range(height):
            centre = x + 0.5
            below = [
                y1 + (centre - x1) * (y2 - y1) / (x2 - x1) <= y + 0.5 for (x1, y1), (x2, y2) in edges if (x1 <= centre) != (x2 <= centre)
            ]
            if sum(below) % 2:
                inside.add(x * height + y)
    return inside


def test_rows_and_polygons_of_a_key_become_one_mask(spark):
    """Keys repeat and may be null; polygons overlap, touch, repeat a point or lie on half pixels."""
    draw = random.Random(7)
    rows, wanted = [], {}
    for n in range(60):
        key = (draw.choice([1, 2, None]), draw.choice([0, None]), draw.choice([5, 6, None]))
        shapes = [[draw.choice([round(draw.uniform(-4, 24), 2), draw.randint(-8, 48) / 2]) for _ in range(2 * draw.randint(1, 6))]
                  for _ in range(draw.randint(0, 3))]
        rows.append((*key, 20, 15, shapes))
        for shape in shapes:
            if len(shape) >= 6:
                wanted.setdefault(key, set()).update(_filled(shape, 15, 20))
    rows.append((9, 9, 9, 20, 15, None))
    runs = mk.polygon_runs(spark.createDataFrame(rows, KINDS)).collect()
    got = {}
    for r in runs:
        key = (r.image_id, r.label, r.instance_id)
        pixels = set(range(r.run_start, r.run_end))
        assert pixels and not pixels & got.get(key, set())
        got.setdefault(key, set()).update(pixels)
    assert got == {k: v for k, v in wanted.items() if v}
    # Merged: no run starts where another of its mask ends.
    ends = {(r.image_id, r.label, r.instance_id, r.run_end) for r in runs}
    assert not any((r.image_id, r.label, r.instance_id, r.run_start) in ends for r in runs)


def test_wide_polygons_are_filled_a_few_at_a_time(monkeypatch):
    parts = [[{"points": [0.0, 0.0, w, 0.0, w, 3.0, 0.0, 3.0], "_low": 0, "_high": int(w), "height": 5}] * n
             for w, n in ((4.0, 1), (9.0, 2), (30.0, 1), (2.0, 3), (2.0, 1))]
    kind = pa.list_(pa.struct({"points": pa.list_(pa.float64()), "_low": pa.int32(), "_high": pa.int32(), "height": pa.int64()}))
    whole = mk._filled(pa.array(parts, kind))
    monkeypatch.setattr(mk, "FILL_COLUMNS", 10)
    assert mk._filled(pa.array(parts, kind)).equals(whole) and [len(r["starts"]) for r in whole.to_pylist()] == [4, 9, 30, 2, 2]
    assert len(mk._filled(pa.array([], kind))) == 0


def test_no_polygons_no_runs(spark):
    assert mk.polygon_runs(spark.createDataFrame([(1, 1, 1, 20, 15, [[0.0, 0.0, 1.0, 1.0]])], KINDS)).collect() == []


def test_runs_are_not_shuffled(spark):
    """Polygons meet before they are filled; nothing is exchanged or sorted by its runs."""
    square = F.array(*[F.lit(float(v)) for v in (0, 0, 90, 0, 90, 90, 0, 90)])
    rows = spark.range(50).select(
        F.col("id").alias("image_id"), F.lit(1).alias("label"), F.lit(1).alias("instance_id"), F.lit(100).alias("width"),
        F.lit(100).alias("height"), F.array(square).alias("polygons"),
    )
    runs = mk.polygon_runs(rows)
    assert runs.count() == 50 * 90
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "run_start" not in plan.split("Generate", 1)[1].split("\n", 1)[1]
