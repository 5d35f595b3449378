import random
import re

import pandas as pd
import pytest

from gridmark.sources import media, yolo
from gridmark.sources import tables as tb
from gridmark.sources.lines import _written, numbered_lines, write_files


@pytest.fixture(params=[37, 1 << 27])
def byte_range(request, spark):
    names = {"spark.sql.files.maxPartitionBytes": f"{request.param}b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_lines_keep_their_numbers_over_byte_ranges(spark, tmp_path, byte_range):
    draw, want = random.Random(2), []
    for number in range(4):
        texts = [draw.choice(["", "a", "é" * 9, "x,y , z", "  # note", "0.5 " * 12]) for _ in range(draw.randrange(1, 60))]
        end = ["\n", "\r\n"][number % 2]
        folder = tmp_path / f"d{number % 2}"
        folder.mkdir(exist_ok=True)
        (folder / f"m{number}.txt").write_bytes(end.join([*texts, ""] if number else texts).encode())
        kept = texts if number or texts[-1] else texts[:-1]  # a file does not end in an empty line of its own
        want += [(f"m{number}.txt", i, t) for i, t in enumerate(kept)]
    (tmp_path / "other.csv").write_text("not this\n")
    got = [(r.file_path.rsplit("/", 1)[1], r.line_no, r.text) for r in numbered_lines(spark, str(tmp_path), "*.txt").collect()]
    assert sorted(got) == sorted(want)


def test_metrics_and_manifests_in_byte_ranges(spark, tmp_path, byte_range):
    (tmp_path / "run_a").mkdir()
    rows = [f"{i},{i * 2},{i / 4},{'' if i % 3 else i}" for i in range(40)]
    (tmp_path / "run_a" / "metrics.csv").write_text("\nstep,epoch,train/loss,val/mAP\n" + "\n\n".join(rows) + "\n")
    got = {(r.run, r.epoch, r.step, r.metric, r.value) for r in tb.read_metrics(spark, str(tmp_path)).collect()}
    want = {("run_a", 2 * i, i, "loss", i / 4) for i in range(40)} | {("run_a", 2 * i, i, "mAP", float(i)) for i in range(0, 40, 3)}
    assert got == want
    (tmp_path / "list.csv").write_text("name,PATH\n" + "".join(f"n{i},img/{i}.jpg\n# gone,x\n" for i in range(30)))
    entries = media.read_manifests(spark, str(tmp_path / "list.csv")).collect()
    found = sorted(r.source for r in entries)
    assert found[:1] == ["img/0.jpg"] and len([f for f in found if f.startswith("img/")]) == 30
    assert {r.resolved for r in entries if r.source == "img/3.jpg"} == {f"{tmp_path}/img/3.jpg"}


def test_files_are_written_under_their_names(spark, tmp_path):
    rows = [(f"train/labels/s{i % 7}.txt", i, f"0 0.{i} 0.5 0.1 0.1") for i in range(50)] + [("val/labels/é.txt", 0, "1 0.5 0.5 0.1 0.1")]
    lines = spark.createDataFrame(rows, "name string, line_no int, text string")
    for _ in range(2):  # again over the same files
        written = write_files(lines, str(tmp_path))
        assert {r.name: r.lines for r in written.collect()} == {n: sum(r[0] == n for r in rows) for n, *_ in rows}
    assert (tmp_path / "train/labels/s1.txt").read_text() == "".join(f"{t}\n" for n, _, t in rows if n.endswith("s1.txt"))
    found = yolo.read_label_lines(spark, str(tmp_path)).collect()
    assert len(found) == 51 and {(r.split, r.stem) for r in found if not re.match(r"s\d", r.stem)} == {("val", "é")} or {r.split for r in found} == {"train", "val"}


def test_a_file_is_written_as_its_rows_come(tmp_path):
    batches = [pd.DataFrame({"name": n, "text": t}) for n, t in ((["x/a", "x/a"], ["1", "2"]), (["x/a", "x/b"], ["3", None]), (["x/b"], ["5"]))]
    written = pd.concat(_written(str(tmp_path), iter(batches)))
    assert list(zip(written["name"], written["lines"])) == [("x/a", 3), ("x/b", 2)]
    assert [(tmp_path / "x" / n).read_text() for n in "ab"] == ["1\n2\n3\n", "None\n5\n"]


def test_fields_of_a_line_are_split_once(spark):
    rows = spark.createDataFrame([("0 0.5 0.5 0.2 0.2", 8, 6)], "text string, width int, height int")
    for parsed in (yolo.parse_lines(rows, 1), yolo.parse_pose_lines(rows, 1, 0, 3)):
        plan = parsed.filter("reason IS NULL")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1
