"""Queries of this subpackage, and the SQL each one must agree with where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_MODULES = ("sharding", "embedding_dedup", "jaccard_join", "mixing", "line_dedup", "packing", "language_model",
            "quality_rules", "token_counts", "license_scan", "best_fit_packing", "hard_negatives", "whitening")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def load_all() -> None:
    for module in _MODULES:
        importlib.import_module(f"gridmark.llm.{module}")
