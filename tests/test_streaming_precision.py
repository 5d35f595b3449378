import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmark.operators import average_precision as ap
from gridmark.operators import matching as m
from gridmark.streaming import evaluation as se
from gridmark.streaming import precision as sp
from tests.test_matching import frames, random_case


def rows_of(result):
    precision = {(r.label, r.area_range, round(r.iou, 4), r.recall_level): r.precision for r in result.precision.collect()}
    recall = {(r.label, r.area_range, round(r.iou, 4), r.max_dets): r.recall for r in result.recall.collect()}
    return precision, recall


@pytest.mark.parametrize("cap", [None, 3])
def test_image_rows_match_like_tables(spark, cap):
    dets, gts = random_case(8, per_image=20)
    d, g = frames(spark, dets, gts)
    lanes = m.coco_lanes((0.5, 0.8))
    images = se.pack_images(d, g).unionByName(
        spark.createDataFrame([(900, None, None), (901, [], [])], se.IMAGE_ROWS)
    )
    got = m.match_groups(m.image_groups(images, lanes, cap), lanes)
    want = m.match_lanes(d, g, lanes, max_dets=cap)
    columns = ["image_id", "label", "det_idx", "score", "rank", "tp_mask", "ignore_mask"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_runs_merge_in_order_and_stay_few(monkeypatch):
    monkeypatch.setattr(sp, "SHORT", 4)
    monkeypatch.setattr(sp, "LONG", 256)

    class Runs(dict):
        containsKey = dict.__contains__
        getValue = dict.__getitem__
        removeKey = dict.pop
        updateValue = dict.__setitem__

    keeper = sp.CurveRuns()
    keeper.runs = Runs()
    draw = np.random.default_rng(0)
    parts = []
    for _ in range(400):
        part = np.zeros(draw.integers(1, 9), sp._ROW)
        part["score"] = draw.choice([0.1, 0.5, 0.9, np.nan], len(part))
        part["image_id"], part["rank"] = draw.integers(0, 99, len(part)), draw.integers(0, 9, len(part))
        parts.append(part)
        keeper._insert(sp.in_order(part))
    kept = [np.frombuffer(run[0], sp._ROW) for run in keeper.runs.values()]
    assert sum(map(len, kept)) == sum(map(len, parts))
    whole = sp.in_order(np.concatenate(parts))
    assert sp.in_order(np.concatenate(kept)).tobytes() == whole.tobytes()
    assert all(sp.in_order(run).tobytes() == run.tobytes() for run in kept)
    final = [run for run in kept if len(run) >= 256]
    assert len(kept) - len(final) <= 8 and max(map(len, kept)) < 1024


def test_stream_equals_batch_over_restart_and_replay(spark, tmp_path, monkeypatch):
    sp.use_rocksdb(spark)
    dets, gts = random_case(17, images=9, per_image=12)
    random.Random(1).shuffle(dets)
    d, g = frames(spark, dets, gts)
    images = se.pack_images(d, g).persist()
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    options = {"iou_grid": (0.5, 0.75), "max_dets": (1, 5, 8)}

    def run(low, high, files):
        images.filter(F.col("image_id").between(low, high)).repartition(files).write.mode("append").parquet(folder)
        restart()

    def restart():
        stream = spark.readStream.schema(se.IMAGE_ROWS).option("maxFilesPerTrigger", 1).parquet(folder)
        running = sp.precision_stream(stream, checkpoint, parts=2, **options).trigger(availableNow=True).start()
        running.awaitTermination()
        assert running.exception() is None

    def expect(high):
        subset = F.col("image_id") <= high
        want = ap.evaluate(d.filter(subset), g.filter(subset), recall_grid=(0.0, 0.25, 0.3, 1.0), **options)
        got = sp.precision_so_far(spark, checkpoint, recall_grid=(0.0, 0.25, 0.3, 1.0), **options)
        assert rows_of(got) == rows_of(want)

    run(0, 5, 2)
    expect(5)
    # The last batch was processed but its commit was lost: it is run again and still counts once.
    commits = os.path.join(checkpoint, "commits")
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        if os.path.exists(os.path.join(commits, name)):
            os.remove(os.path.join(commits, name))
    restart()
    expect(5)
    run(6, 8, 1)
    expect(8)


def test_own_recall_levels_and_any_number_of_caps(spark):
    dets, gts = random_case(3)
    d, g = frames(spark, dets, gts)
    fine = ap.evaluate(d, g, max_dets=(2, 7))
    coarse = ap.evaluate(d, g, max_dets=(2, 7), recall_grid=(0.0, 0.5, 1.0))
    exact, found = rows_of(fine)[0], rows_of(coarse)[0]
    assert found == {k: v for k, v in exact.items() if k[3] in (0.0, 0.5, 1.0)}
    stats = {r.statistic for r in ap.summarize_boxes(coarse, (2, 7)).collect()}
    assert stats == {"AP", "AP50", "AP75", "APs", "APm", "APl", "AR2", "AR7", "ARs", "ARm", "ARl"}
    with pytest.raises(ValueError):
        ap.evaluate(d, g, recall_grid=(0.5, 0.0))
