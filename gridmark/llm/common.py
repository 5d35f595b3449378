"""Shared pieces: reading tables, cutting lineage through written tables, words as columns, and names that do not clash."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.scale import run_folder

# White space that separates words: space and the five ASCII controls from tab to carriage return.
GAPS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write *df* below the shared checkpoint folder and read it back, so lost executors re-read it, not recompute it."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: Iterable[str]) -> str:
    """*name*, with underscores added until no column in *taken* has it (case does not distinguish columns)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The words of *text* as an array; no text has no words."""
    spaced = F.translate(F.coalesce(text, F.lit("")), GAPS[1:], " " * (len(GAPS) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def bind(value: Column, use) -> Column:
    """``use(value)`` with *value* computed once for the row, also inside higher-order functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
