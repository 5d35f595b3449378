import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"

_RUN = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
assert set(entry.oracle_sql()) <= set(entry.queries())
print("queries", len(entry.queries()))
if len(sys.argv) > 2:
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    print("rows", entry.queries()["score_images_plugin"](spark, sys.argv[2]).count())
    spark.stop()
"""


def run_elsewhere(root, cwd, *arguments):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", _RUN, str(root), *arguments], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return dict(line.split() for line in done.stdout.splitlines() if line.startswith(("queries", "rows")))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_workers_find_the_package_from_any_folder(tmp_path):
    assert int(run_elsewhere(ROOT, tmp_path, FOLDER)["rows"]) > 0


def test_entry_without_the_corpus_operators(tmp_path):
    """Also where an empty folder of them is left."""
    copy = tmp_path / "copy"
    shutil.copytree(f"{ROOT}/gridmark", copy / "gridmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", copy)
    without = run_elsewhere(copy, tmp_path)["queries"]
    (copy / "gridmark" / "llm" / "__pycache__").mkdir(parents=True)
    assert run_elsewhere(copy, tmp_path)["queries"] == without and int(without) > 130
