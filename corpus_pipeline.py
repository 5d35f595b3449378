"""A training corpus from raw documents: quality rules, line dedup, near-duplicate join, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.llm.common import fresh, read_table, stored
from gridmark.llm.jaccard_join import near_duplicate_classes
from gridmark.llm.line_dedup import without_shared_lines
from gridmark.llm.mixing import mixed_documents
from gridmark.llm.packing import pack
from gridmark.llm.quality_rules import filter_by_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return filter_by_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; what is left empty goes."""
    cleaned = without_shared_lines(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: by id (none last), then text hash, then running number.

    Rows are classed one by one, so repeated rows and rows without id are too; rows without words all stay.
    """
    row, key = fresh("row", docs.columns), fresh("text_key", docs.columns)
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-rows")
    classes = near_duplicate_classes(numbered, doc_id=row).select(F.col("doc_id").alias("member"), "component_id")
    order = numbered.select(row, F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias(key))
    order = classes.join(order, F.col("member") == F.col(row))
    first = order.groupBy("component_id").agg(F.min(F.struct("none", "doc_id", key, row)).alias("first"))
    return numbered.join(first.select(F.col(f"first.{row}").alias(row)), row, "left_semi").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, placed in sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("source_mixing", mixture),
    ("mixture_packing", packing),
]

# Near-duplicate classes and token ids have no SQL form; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus made from ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
