"""The catalogue of queries. A query is a function (spark, folder) -> DataFrame; its oracle is SQL for another engine."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_MODULES = ("annotation_queries", "source_queries", "decode_queries", "matching_queries", "precision_queries",
            "mask_queries", "run_queries", "shard_queries", "stream_queries")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def load_all() -> None:
    for module in _MODULES:
        importlib.import_module(f"gridmark.plans.{module}")
