"""A count sketch of fixed size: how often hashes fall into each of 2^BITS buckets, added up over the whole corpus.

Each task counts its own hashes and sends the buckets in blocks; blocks are added in Spark. The result has one size
whatever the corpus, so it may be brought to the driver and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 20
BLOCK_BITS = 14
BLOCK_SCHEMA = "block int, places binary, counts binary"


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


class TaskCounts:
    """The counts of one task."""

    def __init__(self) -> None:
        self._counts = np.zeros(1 << BITS, dtype=np.int64)

    def add(self, hashes: np.ndarray) -> None:
        self._counts += np.bincount(bucket_of(hashes), minlength=1 << BITS)

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        for block, counts in enumerate(self._counts.reshape(-1, 1 << BLOCK_BITS)):
            places = np.flatnonzero(counts)
            if len(places):
                yield block, places.astype("<u2").tobytes(), counts[places].astype("<i8").tobytes()


def _add_blocks(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << BLOCK_BITS, dtype=np.int64)
    for places, counts in zip(table["places"].to_pylist(), table["counts"].to_pylist(), strict=True):
        total[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "<i8")
    places = np.flatnonzero(total)
    row = [[table["block"][0].as_py()], [places.astype("<u2").tobytes()], [total[places].astype("<i8").tobytes()]]
    return pa.table([pa.array(row[0], pa.int32()), pa.array(row[1], pa.binary()), pa.array(row[2], pa.binary())],
                    names=["block", "places", "counts"])


def add_up(blocks: DataFrame) -> np.ndarray:
    """The counts of all buckets; 2^(BITS - BLOCK_BITS) rows reach the driver."""
    total = np.zeros((1 << (BITS - BLOCK_BITS), 1 << BLOCK_BITS), dtype=np.int64)
    for row in blocks.groupBy("block").applyInArrow(_add_blocks, BLOCK_SCHEMA).collect():
        total[row.block, np.frombuffer(row.places, "<u2")] = np.frombuffer(row.counts, "<i8")
    return total.reshape(-1)
