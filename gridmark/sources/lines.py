"""Lines of text files with their numbers, and small text files written under their own names."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmark import scale


def numbered_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``file_path, line_no`` (from 0) and ``text`` of the lines of all files below *path* whose names match *pattern*.

    Files are read by byte ranges, so a long one is many tasks; a line's number is its place in its range plus the lines of
    the ranges before it.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
        F.col("value").alias("text"),
    )
    block = ["file_path", "_block"]
    earlier = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per byte range.
    before = raw.groupBy(*block).agg(F.count("*").alias("_lines"))
    before = before.select(*block, F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    placed = raw.withColumn("_place", F.row_number().over(Window.partitionBy(*block).orderBy("_pos")) - 1)
    numbered = placed.join(before, block).withColumn("line_no", (F.col("_before") + F.col("_place")).cast("int"))
    return numbered.select("file_path", "line_no", F.regexp_replace("text", "\r$", "").alias("text"))


def _written(folder: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files of rows (name, text) in the order of names, each written as its rows come; rows (name, lines)."""
    system, root = FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))
    out, open_name, lines, places = None, None, 0, set()
    try:
        for batch in batches:
            names, counts = [], []
            for name, texts in batch.groupby("name", sort=False, dropna=False)["text"]:
                name = None if name != name else name
                if out is None or name != open_name:
                    if out is not None:
                        out.close()
                        names.append(open_name)
                        counts.append(lines)
                    place = f"{root}/{name}".rsplit("/", 1)[0]
                    if place not in places:
                        system.create_dir(place, recursive=True)
                        places.add(place)
                    out, open_name, lines = system.open_output_stream(f"{root}/{name}"), name, 0
                out.write("".join(f"{t}\n" for t in texts).encode())
                lines += len(texts)
            yield pd.DataFrame({"name": names, "lines": counts})
        if out is not None:
            yield pd.DataFrame({"name": [open_name], "lines": [lines]})
    finally:
        if out is not None:
            out.close()


def write_files(lines: DataFrame, folder: str) -> DataFrame:
    """Write ``name, line_no, text`` as one small file per name below *folder*; rows (name, lines) of what was written.

    For labels and manifests, where the file's name carries meaning. Tasks write whole files, so a repeated task writes the
    same files again. A task reads its files in turn, and holds none of them whole.
    """
    placed = lines.select("name", "line_no", "text").repartition("name").sortWithinPartitions("name", F.col("line_no").asc_nulls_last())
    written = placed.select("name", "text").mapInPandas(partial(_written, folder), "name string, lines bigint")
    return scale.cut_lineage(written)
