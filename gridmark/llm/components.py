"""Connected components of a link table, in rounds of joins that shrink the graph (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``a > b``: every node's (larger, or smaller) neighbours are tied to its smallest one."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
    tied = both.join(least, "a")
    if large:
        tied = tied.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        tied = tied.select("b", "low").unionByName(tied.select(F.col("a").alias("b"), "low"))
        tied = tied.select(F.col("b").alias("a"), F.col("low").alias("b"))
    return tied.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node that *links* (a, b) name: label is the smallest node reachable.

    Each round writes its edges to the shared folder; rounds grow with the logarithm of the largest component. Nodes
    may be of any ordered type. Null and self links are left out.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(pairs.filter(F.col("a") > F.col("b")).distinct(), "edges")
    signature = None
    while True:
        edges = stored(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == signature:
            break
        signature = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
