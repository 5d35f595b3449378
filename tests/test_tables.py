import json
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmark import scale
from gridmark.operators import annotations as an
from gridmark.operators import decode as dc
from gridmark.operators import labels as lb
from gridmark.operators import runs as rn
from gridmark.operators import sampling as sp
from gridmark.operators import sharding as sh
from gridmark.operators import weekly as wk
from gridmark.schemas import CATEGORIES
from gridmark.sources import coco, media, yolo
from gridmark.sources import tables as tb
from gridmark.streaming import frames as sf


def test_ordered_ids_and_running_totals(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g long, v long").repartition(6)
    ids = {r.k: r.id for r in scale.ordered_ids(df, [F.col("k").desc()], "id").collect()}
    assert ids == {k: 499 - k for k, _, _ in rows}
    want, sums = {}, {}
    for k, g, v in sorted(rows):
        sums[g] = sums.get(g, 0) + v
        want[k] = sums[g]
    for large in (False, True):
        got = scale.running_totals(df, ["g"], ["k"], {"total": "v"}, large=large).collect()
        assert {r.k: r.total for r in got} == want
        before = scale.running_totals(df, ["g"], ["k"], {"total": "v"}, large=large, inclusive=False).collect()
        assert {r.k: r.total for r in before} == {k: want[k] - v for k, _, v in rows}


def categories(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], CATEGORIES)


def test_parent_categories(spark):
    used = lambda *ids: spark.createDataFrame([(i,) for i in ids], "category_id long")
    tree = categories(spark, [(0, "animals", "none"), (1, "cat", "animals"), (2, "dog", "animals"), (3, "x", "x")])
    kept = lambda c, u: sorted(r.category_id for r in lb.drop_parent_categories(c, u).collect())
    assert kept(tree, used(1, 2)) == [1, 2, 3]
    assert kept(tree, used(0, 1)) == [0, 1, 2, 3]
    circle = categories(spark, [(1, "a", "b"), (2, "b", "a")])
    assert kept(circle, used()) == [1, 2]
    space = lb.label_space(lb.drop_parent_categories(tree, used(1)))
    assert {r.category_id: r.label for r in space.collect()} == {1: 0, 2: 1, 3: 2}


def test_strict_mode(spark):
    bad = spark.createDataFrame([(1, "orphan")], "id long, reason string")
    with pytest.raises(an.RejectedRows):
        an.require_no_rejects(bad)
    an.require_no_rejects(bad.limit(0))


def test_coco_reader(spark, tmp_path):
    folder = tmp_path / "train"
    folder.mkdir()
    document = {
        "images": [{"id": 7, "file_name": "a.jpg", "width": 100, "height": 100}],
        "categories": [{"id": 1, "name": "cat", "supercategory": "none"}],
        "annotations": [
            {"id": 1, "image_id": 7, "category_id": 1, "bbox": [10, 10, 30, 30], "area": 900, "iscrowd": 0,
             "segmentation": [[1, 1, 5, 1, 5, 5]]},
            {"id": 2, "image_id": 7, "category_id": 1, "bbox": [1, 2, 3], "area": 9, "iscrowd": 1,
             "segmentation": {"counts": [1, 2], "size": [10, 10]}},
        ],
    }
    (folder / "_annotations.coco.json").write_text(json.dumps(document, indent=1))
    tables = coco.read_coco(spark, str(folder / "_annotations.coco.json"))
    rows = tables.annotations.withColumn("kind", an.segmentation_kind(F.col("segmentation"))).orderBy("ann_id").collect()
    assert [(r.x, r.h, r.iscrowd, r.kind, r.split) for r in rows] == [(10.0, 30.0, False, "polygon", "train"), (None, None, True, "rle", "train")]
    _, rejects = an.crowd_regions(tables.annotations)
    assert rejects.first().reason == "missing bbox"
    coco.save_tables(tables, str(tmp_path / "landed"))
    assert spark.read.parquet(str(tmp_path / "landed" / "images")).filter("split = 'train'").count() == 1
    # The usual layout, read by its root: a folder per split, with a name that file listings skip.
    (tmp_path / "val").mkdir()
    (tmp_path / "val" / "_annotations.coco.json").write_text(json.dumps(document))
    for path, splits in ((tmp_path, ["train", "val"]), (folder, ["train"])):
        whole = coco.read_coco(spark, str(path))
        assert sorted(r.split for r in whole.images.collect()) == splits
        assert whole.annotations.count() == 2 * len(splits)


def test_labels_of_two_splits_with_the_same_stem(spark, tmp_path):
    for split, label in (("train", 0), ("val", 1)):
        (tmp_path / "labels" / split).mkdir(parents=True)
        (tmp_path / "labels" / split / "0001.txt").write_text(f"{label} 0.5 0.5 0.5 0.5\n")
    images = spark.createDataFrame([(f"/d/images/{s}/0001.jpg",) for s in ("train", "val", "test")], "file_name string")
    joined = yolo.join_images(images, yolo.read_label_lines(spark, str(tmp_path))).collect()
    assert sorted((r.split, r.text and r.text[0]) for r in joined) == [("test", None), ("train", "0"), ("val", "1")]


def test_metrics_of_runs_with_other_columns(spark, tmp_path):
    texts = {"a": "epoch,train/loss,val/mAP\n0,0.8,0.4\n", "b": "val/mAP,epoch,train/loss,extra\n0.5,1,0.7,9\n", "empty": ""}
    for run, text in texts.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "metrics.csv").write_text(text)
    rows = {(r.run, r.epoch, r.column, r.value) for r in tb.read_metrics(spark, str(tmp_path)).collect()}
    assert rows == {("a", 0, "train/loss", 0.8), ("a", 0, "val/mAP", 0.4), ("b", 1, "train/loss", 0.7), ("b", 1, "val/mAP", 0.5), ("b", 1, "extra", 9.0)}


def test_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.5 0.5\r\n\n0 0.25 0.25 0.75 0.25 0.75 0.75 0.25 0.75\n")
    (tmp_path / "b.txt").write_text("1 0.5\n")
    images = spark.createDataFrame([("d/a.jpg", 8, 6), ("d/b.png", 8, 6), ("d/c.png", 8, 6)], "file_name string, width int, height int")
    joined = yolo.join_images(images, yolo.read_label_lines(spark, str(tmp_path)))
    assert joined.filter("text IS NULL").first().file_name == "d/c.png"
    parsed = yolo.parse_lines(joined.filter("text IS NOT NULL"), 1).orderBy("file_name", "line_no").collect()
    assert [(r.line_no, r.x1, r.y1, r.x2, r.y2, r.reason) for r in parsed[:2]] == [
        (1, 2.0, 1.5, 6.0, 4.5, None), (3, 2.0, 1.5, 6.0, 4.5, None)]
    assert parsed[0].polygon == [2.0, 1.5, 6.0, 1.5, 6.0, 4.5, 2.0, 4.5]
    assert parsed[2].reason == "too few fields"


def test_pose_lines(spark):
    rows = [("0 0.5 0.5 0.5 0.5 0.25 0.25 2 0 0 0", 3), ("0 0.5 0.5 0.5 0.5 0.25 0.25 0 0", 2), ("0 0.5 0.5 0.5 0.5 -0.1 0.5 1.5 0.5", 2)]
    lines = spark.createDataFrame([(t, 8, 6, d) for t, d in rows], "text string, width int, height int, dim int")
    three = yolo.parse_pose_lines(lines.filter("dim = 3"), 1, 2, 3).first().keypoints
    two = [r.keypoints for r in yolo.parse_pose_lines(lines.filter("dim = 2"), 1, 2, 2).collect()]
    assert three == [2.0, 1.5, 2.0, 0.0, 0.0, 0.0]
    assert two == [[2.0, 1.5, 2.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 8.0, 3.0, 2.0]]


def test_manifests_and_media(spark, tmp_path):
    (tmp_path / "a.csv").write_text('# list\nname,Source\nx,"b,1.jpg"\ny\nz,0\n')
    (tmp_path / "b.txt").write_text("﻿clip.mp4\n# no\n\nrtsp://h/1\n")
    rows = {(r.source, r.kind) for r in media.read_manifests(spark, str(tmp_path)).collect()}
    assert rows == {("b,1.jpg", "image"), ("0", "camera"), ("clip.mp4", "video"), ("rtsp://h/1", "live")}
    resolved = {r.source: r.resolved for r in media.read_manifests(spark, str(tmp_path)).collect()}
    assert resolved["clip.mp4"] == str(tmp_path / "clip.mp4") and resolved["0"] == "0"
    for name in ("x.JPG", "._y.jpg", "z.txt"):
        (tmp_path / name).write_bytes(b"123")
    assert [(r.file_name, r.length) for r in media.list_media(spark, str(tmp_path)).collect()] == [("x.JPG", 3)]


def test_metrics_and_daily_files(spark, tmp_path):
    path = tmp_path / "version_0"
    path.mkdir()
    (path / "metrics.csv").write_text("epoch,step,train/loss,val/mAP\n0,1,2.5,\n0,2,,0.5\n")
    rows = {(r.run, r.split, r.metric, r.value) for r in tb.read_metrics(spark, str(path / "metrics.csv")).collect()}
    assert rows == {("version_0", "train", "loss", 2.5), ("version_0", "val", "mAP", 0.5)}
    (path / "bad.csv").write_text("step\n1\n")
    with pytest.raises(ValueError):
        tb.read_metrics(spark, str(path / "bad.csv"))
    (path / "daily.csv").write_text("day,category,downloads\n2026-08-24,without_mirrors,1\n2026-08-24,without_mirrors,1\n")
    with pytest.raises(an.RejectedRows):
        tb.read_daily_counts(spark, str(path / "daily.csv"))


def test_shards(spark, tmp_path):
    assert [spark.range(1).select(sh.footprint(F.lit(n))).first()[0] for n in (0, 513)] == [512, 1536]
    samples = spark.createDataFrame([("train", i, 1000 + i, 100, "x") for i in range(40)],
                                    "split string, position long, payload_bytes long, sidecar_bytes long, lang string")
    plain = sh.plan_shards(samples, 9_000)
    sliced = sh.plan_shards(samples.repartition(3), 9_000)
    key = lambda df: sorted((r.position, r.shard_id) for r in df.collect())
    assert key(plain) == key(sliced)
    index = tb.shard_index(plain, ["position", "payload_bytes"])
    again = tb.shard_index(samples.repartition(5).transform(lambda d: sh.plan_shards(d, 9_000)), ["position", "payload_bytes"])
    assert sorted(index.collect()) == sorted(again.collect())
    tb.write_shards(plain, index, str(tmp_path))
    read = tb.read_shard_index(spark, str(tmp_path), "train")
    assert read.agg(F.sum("samples")).first()[0] == 40
    with pytest.raises(ValueError):
        tb.read_shard_index(spark, str(tmp_path), "val")
    order = sh.assign_slots(sh.epoch_order(read, 2), 3).collect()
    for epoch in (0, 1):
        ids = [r.shard_id for r in order if r.epoch == epoch]
        assert len(ids) == len(set(ids)) == read.count()


def test_draws(spark):
    images = spark.range(300).withColumnRenamed("id", "image_id")
    one = {r.image_id for r in sp.subset(images.repartition(7), 50, 3).collect()}
    assert len(one) == 50 and one == {r.image_id for r in sp.subset(images, 50, 3).collect()}
    assert one != {r.image_id for r in sp.subset(images, 50, 4).collect()}
    tuning, test = sp.tuning_and_test(images, 100, 150)
    assert (tuning.count(), test.count(), sp.overlap(tuning, test).count()) == (100, 150, 0)
    with pytest.raises(Exception, match="requested 301"):
        sp.subset(images, 301).collect()
    padded = sp.pad_to_multiple(images, "image_id", 64, 2, minimum=1000)
    assert padded.count() == 1024 and padded.filter("NOT is_repeat").count() == 300


def test_latency_and_best(spark):
    rng = random.Random(8)
    taken = {name: [rng.uniform(0.5, 60.0) for _ in range(size)] for name, size in (("engine", 57), ("eager", 20), ("one", 1))}
    timings = spark.createDataFrame([(k, v) for k, values in taken.items() for v in values], "format string, ms double")
    for row in rn.latency_statistics(timings, ["format"]).collect():
        values = np.array(taken[row.format])
        assert (row.median_ms, row.p95_ms) == pytest.approx((np.median(values), np.percentile(values, 95)), rel=1e-12)
    values = spark.createDataFrame([("r", i, v) for i, v in enumerate([0.1, 0.3, float("nan"), 0.3, 0.4])], "run string, epoch int, value double")
    best = rn.best_so_far(values, ["run"], ["epoch"]).orderBy("epoch").collect()
    assert [r.best_epoch for r in best] == [0, 1, 1, 1, 4]
    flat = spark.createDataFrame([("r", i, 0.5, None) for i in range(6)], "run string, epoch int, regular double, ema double")
    assert rn.early_stop(flat, ["run"], patience=3).first().stopped_epoch == 3
    assert rn.early_stop(flat, ["run"], patience=9).first().stopped_epoch is None


def test_weekly(spark):
    rng = random.Random(12)
    counts = {date(2025, 2, 26) + timedelta(days=i): rng.randrange(5000) for i in range(33)}  # a Wednesday to a Sunday
    del counts[date(2025, 3, 19)]
    daily = spark.createDataFrame([("p", d, n) for d, n in counts.items()], "series string, day date, downloads long")
    weeks = {r.week_start: r for r in wk.weekly_sums(daily, ["series"]).collect()}
    mondays = [date(2025, 2, 24) + timedelta(days=7 * i) for i in range(5)]
    assert sorted(weeks) == mondays
    for monday in mondays:
        own = [counts[d] for i in range(7) if (d := monday + timedelta(days=i)) in counts]
        assert (weeks[monday].downloads, weeks[monday].complete) == (sum(own), len(own) == 7)
    assert [weeks[m].complete for m in mondays] == [False, True, True, False, True]


def test_class_thresholds(spark):
    names = spark.createDataFrame([(0, "cat"), (1, "dog")], "label long, name string")
    rows = spark.createDataFrame([(0, 0.5), (0, 0.51), (1, 0.8), (1, float("nan")), (9, 0.99)], "label long, score double")
    kept = dc.apply_class_thresholds(rows, dc.threshold_table(names, {"dog": 0.7})).collect()
    assert sorted((r.label, r.score) for r in kept) == [(0, 0.51), (1, 0.8)]
    with pytest.raises(Exception, match="unknown class name: bird"):
        dc.threshold_table(names, {"bird": 0.7}).collect()


def test_prefilter_equals_full_sort(spark):
    rng = random.Random(2)
    raw = spark.createDataFrame(
        [(i // 6, i % 6, [rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0, float("nan")]) for _ in range(4)], 0.5, 0.5, 0.2, 0.2) for i in range(60)],
        "image_id long, query_idx int, logits array<double>, cx double, cy double, w double, h double",
    )
    scored = dc.explode_scores(raw, clipped=True)
    full = dc.select_topk(scored, 7).filter(~F.isnan("score") & (F.col("score") > 0.4))
    fast = dc.select_topk(scored, 7, 0.4)
    key = lambda df: sorted((r.image_id, r.flat_idx) for r in df.collect())
    assert key(full) == key(fast)


def test_stream_ticks_and_watermarks(spark, tmp_path):
    frames = spark.createDataFrame([(s, t, t * 10 + s) for t in range(5) for s in range(3) if not (s == 2 and t > 2)],
                                   "source long, tick long, frame_idx long")
    assert sorted(r.tick for r in sf.ticks(frames, 3).collect()) == [0, 1, 2]
    assert sf.newest(frames, 1).count() == 3 and sf.newest(frames, 2).count() == 6
    with pytest.raises(ValueError):
        sf.every_nth(frames, 0)


def test_ticks_on_a_stream(spark, tmp_path):
    """Complete ticks are emitted, also where a minute ends between their frames; the incomplete tick 1 never is."""
    rows = [(s, t, t * 10 + s, t * 60 + 59 + s) for t in range(6) for s in range(2) if not (s == 1 and t == 1)]
    frames = spark.createDataFrame(rows, "source long, tick long, frame_idx long, second long")
    frames = frames.withColumn("ts", F.timestamp_seconds(F.col("second"))).drop("second")
    for tick in range(6):
        frames.filter(F.col("tick") == tick).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        sf.ticks(stream, 2, "30 seconds").writeStream.outputMode("append").format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    emitted = sorted(r.tick for r in out)
    assert emitted == [0, 2, 3, 4, 5]
    assert all([f.source for f in r.frames] == [0, 1] for r in out)


def test_streams_read_sharded_tables(spark, tmp_path):
    """A table in many files gives the frames that it gives in one."""
    from gridmark.plans.registry import QUERIES, load_all

    load_all()
    source = "/root/testdata/sf0.001/events.parquet"
    if not __import__("os").path.exists(source):
        pytest.skip("test tables are not here")
    spark.read.parquet(source).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("frame_stride", "newest_frames"):
        sharded, whole = (QUERIES[name](spark, f) for f in (str(tmp_path), "/root/testdata/sf0.001"))
        assert sorted(map(tuple, sharded.collect())) == sorted(map(tuple, whole.collect())) != []
