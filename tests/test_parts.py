"""What a query keeps on disk on its way is bounded: large tables are worked on part by part."""

import datetime
import gc
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridmark import scale
from gridmark.operators import masks as mk
from gridmark.operators import matching as mt
from gridmark.plans import mask_queries as mq
from gridmark.plans import source_queries as sq
from gridmark.plans.fixtures import view
from gridmark.sources import coco

LINES = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,"
    " l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
)


@pytest.fixture
def folder(spark, tmp_path):
    day = datetime.date(2020, 1, 1)
    rows = [(o, o * 7 + n % 3, n % 4, n, 1.0 + n, 2.0, n / 100, n % 5 / 100, "A", "F", day) for o in range(60) for n in range(1, 8)]
    rows += rows[20:60] + [(None, 5, 1, n, 1.0, 2.0, 0.05, 0.02, "A", "F", day) for n in range(1, 4)]
    spark.createDataFrame(rows, LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = spark.createDataFrame([*[(o, o * 3) for o in [*range(60), 7, 7]], (None, 1)], "o_orderkey long, o_custkey long")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def _kept(spark, name):
    return set(Path(scale.prepare_checkpoints(spark).removeprefix("file:")).rglob(f"{name}-*"))


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def _left(spark, before):
    """Shuffle files that were not there before; they are deleted in the background."""
    for _ in range(100):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_parts_are_computed_one_after_the_other(spark):
    rows = spark.range(100).select((F.col("id") % 9).alias("key"), "id").union(spark.createDataFrame([(None, 5), (None, 6)], "key long, id long"))
    rows, seen = scale.stored(rows, "numbers"), []

    def build(left, right):
        pairs = scale.stored(left.join(right.withColumnRenamed("id", "other"), "key").unionByName(left.withColumn("other", F.lit(-1))), "pairs")
        seen.append((len(_kept(spark, "pairs")), len({r.key for r in pairs.select("key").collect()})))
        return pairs

    before, shuffled = len(_kept(spark, "pairs")), _shuffle_files(spark)
    got = scale.in_parts(4, "key", [rows, rows], build, "all-pairs")
    assert len(seen) == 4 and {n for n, _ in seen} == {before + 1} and sum(n for _, n in seen) == 10
    assert len(_kept(spark, "pairs")) == before and not _left(spark, shuffled)
    whole = build(rows, rows)
    assert sorted(got.collect(), key=str) == sorted(whole.collect(), key=str) and got.columns == whole.columns
    assert scale.part_count(rows) == 1


def test_documents_are_on_disk_some_at_a_time(spark, folder, monkeypatch):
    """A part of the documents is read and given up before the next is written; rows stay as they were."""
    monkeypatch.setattr(sq, "_DOCUMENT_OBJECTS", 40)
    monkeypatch.setattr(sq, "_DOCUMENTS_AT_ONCE", 3, raising=False)
    read, lines, before = coco.read_coco_objects, [], _kept(spark, "coco-large")

    def noted(session, path, split):
        folders = _kept(spark, "coco-large") - before
        lines.append(sum(len(file.read_text().splitlines()) for place in folders for file in place.rglob("*.txt")))
        return read(session, path, split)

    monkeypatch.setattr(coco, "read_coco_objects", noted)
    got = sq.coco_large_documents(spark, folder)
    rows = sorted(got.collect(), key=str)
    annotations, images = view(spark, folder, "ann"), view(spark, folder, "img").select("image_id", "file_name", "split")
    names = [c for c in got.columns if c != "segmentation"]
    boxed = annotations.filter("ann_id IS NOT NULL").join(images.select("image_id", "split"), "image_id")
    known = boxed.join(images.select("image_id", "file_name"), "image_id").select(*names)
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, known.collect())) and len(rows) > 420
    assert max(lines) < len(rows) / 2
    assert _kept(spark, "coco-large") == before and not _kept(spark, "json-depths")


def test_stepped_masks_meet_part_by_part(spark, folder, monkeypatch):
    """Images are compared in parts that leave no shuffle files, with the same pairs."""
    whole = sorted(mq.stepped_mask_overlaps(spark, folder).collect())
    monkeypatch.setattr(scale, "part_count", lambda table: 3, raising=False)
    compare, seen = mk._overlaps, []

    def noted(left, right, height):
        seen.append({r.image_id for r in left.select("image_id").collect()})
        return compare(left, right, height)

    monkeypatch.setattr(mk, "_overlaps", noted)
    pairs = mq.stepped_mask_overlaps(spark, folder)
    assert len(seen) == 3 and sum(map(len, seen)) == len(set().union(*seen)) == 61
    assert sorted(pairs.collect()) == whole and len(whole) > 60
    monkeypatch.undo()
    gc.collect()
    before = _shuffle_files(spark)
    scale.stored(mq.stepped_mask_overlaps(spark, folder), "pairs")
    assert not _left(spark, before)


def test_mask_statistics_match_part_by_part(spark, folder, monkeypatch):
    """Overlaps and matches of images are computed in parts, with the same statistics."""
    whole = sorted(mq.mask_statistics(spark, folder).collect())
    monkeypatch.setattr(scale, "part_count", lambda table: 3, raising=False)
    fold, seen = mt._folded, []

    def noted(both, *options):
        seen.append({r.image_id for r in both.select("image_id").collect()})
        return fold(both, *options)

    monkeypatch.setattr(mt, "_folded", noted)
    parts = sorted(mq.mask_statistics(spark, folder).collect())
    assert len(seen) == 3 and sum(map(len, seen)) == len(set().union(*seen)) == 61
    assert parts == whole and len(whole) == 12 and any(r.value > 0 for r in whole)
