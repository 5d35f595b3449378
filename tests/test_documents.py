import json
import random

import pytest

from gridmark import scale
from gridmark.plans import source_queries as sq
from gridmark.sources import coco
from gridmark.sources.documents import document_objects


@pytest.fixture(params=[61, 700, 1 << 27])
def byte_range(request, spark):
    names = {"spark.sql.files.maxPartitionBytes": f"{request.param}b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


HOSTILE = ["}", "{", 'a"b', "\\", "\\\\", '\\"}', "]}", '"images": [{', "é\n\t", "", '{"x": [', "}}}{{{", 'he said ": {"', " "]


def document(seed):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choice(HOSTILE) for _ in range(draw.randrange(4)))
    images = [{"id": i, "file_name": text(), "width": 3, "height": 4, "extra": {"a": {"b": text()}, "c": [{}, {"d": []}]}} for i in range(draw.randrange(1, 12))]
    kinds = [[[1.0, 2.0, 3.0]], {"counts": [1, 2], "size": [3, 4]}, {"counts": text(), "size": [3, 4]}, None]
    annotations = [{"id": i, "image_id": 1, "segmentation": draw.choice(kinds), "bbox": [1, 2, 3, 4]} for i in range(draw.randrange(12))]
    parts = [
        ("info", {"year": 2020, "by": {"name": text(), "of": [{"x": text()}]}}), ("version", text()), ("numbers", [1, 2, [3, 4]]),
        ("texts", [text(), "}", text()]), ("licenses", []), ("empty", {}), ("images", images), ("annotations", annotations),
        ("categories", [{"id": 1, "name": text()}, {}]), ("none", None),
    ]
    draw.shuffle(parts)
    return dict(parts)


@pytest.mark.parametrize("indent", [None, 2])
def test_objects_equal_a_whole_parse(spark, tmp_path, byte_range, indent):
    want = {}
    for seed in range(6):
        whole = document(seed)
        file = tmp_path / f"doc{seed}.json"
        file.write_text(json.dumps(whole, indent=indent, ensure_ascii=seed % 2 == 0) + "\n" * (seed % 3), encoding="utf-8")
        for key, value in whole.items():
            if isinstance(value, list) and value and isinstance(value[0], dict):
                want[file.name, key] = sorted(json.dumps(v, sort_keys=True) for v in value)
    got = {}
    for r in document_objects(spark, str(tmp_path)).collect():
        got.setdefault((r.file.rsplit("/", 1)[1], r.section), []).append(json.dumps(json.loads(r.text), sort_keys=True))
    assert {k: sorted(v) for k, v in got.items()} == want


def canonical(table):
    """Rows as text; JSON that is kept as text may be spaced and escaped differently."""
    rows = [r.asDict(recursive=True) for r in table.collect()]
    return sorted(str(r | ({"segmentation": r["segmentation"] and json.loads(r["segmentation"])} if "segmentation" in r else {})) for r in rows)


def test_tables_equal_the_one_task_reader(spark, tmp_path, byte_range):
    for split in ("train", "val"):
        (tmp_path / split).mkdir()
        (tmp_path / split / "a.json").write_text(json.dumps(document(len(split)), separators=(",", ":")), encoding="utf-8")
    whole, spread = coco.read_coco(spark, f"{tmp_path}/*"), coco.read_coco_objects(spark, f"{tmp_path}/*")
    for name in ("images", "categories", "annotations"):
        one, other = (getattr(t, name) for t in (whole, spread))
        assert one.dtypes == other.dtypes
        assert canonical(one) == canonical(other)
    given = coco.read_coco_objects(spark, f"{tmp_path}/train", "x").images
    assert {r.split for r in given.collect()} == {"x"}


def test_a_document_is_read_by_many_tasks(spark, tmp_path):
    file = tmp_path / "large.json"
    with file.open("w", encoding="utf-8") as out:
        out.write('{"images": [')
        for i in range(60_000):
            out.write((", " if i else "") + json.dumps({"id": i, "file_name": f"{{{i}}}", "width": i % 7, "height": 1}))
        out.write('], "annotations": []}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        assert spark.read.option("lineSep", "}").text(str(file)).rdd.getNumPartitions() >= 4
        images = coco.read_coco_objects(spark, str(file), "train").images
        row = images.selectExpr("count(*) n", "count(distinct image_id) d", "sum(width) w", "count_if(file_name = concat('{', image_id, '}')) f").first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (row.n, row.d, row.w, row.f) == (60_000, 60_000, sum(i % 7 for i in range(60_000)), 60_000)


def test_pieces_are_not_shuffled_by_document(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(document(1)))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = document_objects(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin [_file" in plan


def test_many_annotations_are_several_documents(spark, tmp_path, monkeypatch):
    orders = "id AS o_orderkey, id % 9 AS o_custkey"
    items = (
        "id div 4 AS l_orderkey, id % 23 AS l_partkey, id % 7 AS l_suppkey, CAST(id % 7 + 1 AS INT) AS l_linenumber, CAST(id % 50 AS DOUBLE) AS l_quantity, "
        "1D AS l_extendedprice, 0D AS l_discount, 0D AS l_tax, DATE'2020-01-01' AS l_shipdate, 'A' AS l_returnflag, 'F' AS l_linestatus"
    )
    spark.range(30).selectExpr(*orders.split(", ")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(120).selectExpr(*items.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    folders = []
    run_folder = scale.run_folder
    monkeypatch.setattr(scale, "run_folder", lambda spark, name: folders.append(run_folder(spark, name)) or folders[-1])
    monkeypatch.setattr(sq, "_DOCUMENT_OBJECTS", 25)
    rows = sq.coco_large_documents(spark, str(tmp_path)).collect()
    assert sorted(r.ann_id for r in rows) == sorted(1000 * (i // 4) + i % 4 for i in range(120))
    written = spark.read.text(next(f for f in folders if "/coco-large-" in f)).select("_metadata.file_path").distinct().collect()
    assert len(written) == 2 * 5
