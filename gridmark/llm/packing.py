"""Mixture-controlled packing of documents into sequences by deficit round-robin over source queues.

Each source's documents form one queue of tokens. Every window of WINDOW tokens gives each source its quantum, its
target share of the window, in turn; what rounding withholds is the source's deficit, which is carried to the next
window. The state of this round-robin after any number of tokens has a closed form: the queues are halved again and again,
and of the tokens that reach a half, floor(tokens * its share) go to the first part and the others to the second. Both
counts only rise, every window is filled exactly, and no deficit exceeds one token for each halving. So no window waits
for the one before it: a document finds its own place from its position in its queue, and deficits cross windows and
partitions by arithmetic.

Shares are the sources' own shares of all tokens, so that all queues end together, or given weights; then a source
that runs dry ends a phase, and the others share the windows of the next phase by their weights.

The totals of the queues, one row per source name, are read by the driver to halve them. The stream of windows is cut into sequences of 1,024 tokens, its rest into sequences of falling powers of two, so
nothing is padded. A queue's positions are running totals over range slices, so one source may hold most documents.

Defined results: a null or empty text has the end token alone; a null source is a queue of its own; rows that repeat
an id are documents of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.llm.catalogue import query
from gridmark.llm.common import read_table, stored
from gridmark.llm.token_counts import PIECES, _byte_letters
from gridmark.scale import running_totals

SEQUENCE = 1_024
WINDOW = 64 * SEQUENCE
END_ID = 0


@cache
def encoder(path: str):
    """The vocabulary of a byte-level tokenizers file in a faster encoder with the same ids."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    letters = _byte_letters()
    specials = {t["content"]: t["id"] for t in whole["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in whole["model"]["vocab"].items() if t not in specials}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=specials)


def _tokenized(df: DataFrame, path: str, doc_id: str, text: str, source: str) -> DataFrame:
    """``row, doc_id, queue, n, ids`` with ids in bytes of 32-bit numbers; written, so that row numbers stay."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_to_numpy
        for batch in batches:
            # A few documents at a time keep batches small.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [
                    np.append(encode(t or "", allowed_special="all"), END_ID).astype("<u4") for t in part.column(2).to_pylist()
                ]
                counts = pa.array([len(i) for i in ids], pa.int64())
                packed = pa.array([_narrow(i) for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), counts, packed], ["doc_id", "queue", "n", "ids"]
                )

    queue = F.coalesce(F.concat(F.lit("source "), F.col(f"`{source}`").cast("string")), F.lit("none"))
    narrow = df.select(F.col(f"`{doc_id}`"), queue, F.col(f"`{text}`"))
    rows = narrow.mapInArrow(run, f"doc_id {kind}, queue string, n bigint, ids binary")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "packing-tokens")


def _narrow(ids: np.ndarray) -> bytes:
    """A first byte for the width, then 16-bit numbers where they are enough."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\4" + ids.tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if blob[0] == 2 else "<u4", offset=1).astype("<u4")


Halving = tuple[bool, int, int]  # whether the queue is in the second part; tokens of the first part; tokens of both


def halvings(sizes: list[int], queue: int) -> list[Halving]:
    """The halvings on the way to one of the queues."""
    low, high, path = 0, len(sizes), []
    while high - low > 1:
        middle = (low + high) // 2
        path.append((queue >= middle, sum(sizes[low:middle]), sum(sizes[low:high])))
        low, high = (middle, high) if queue >= middle else (low, middle)
    return path


def served(tokens: int, path: list[Halving]) -> tuple[int, int]:
    """Of the first *tokens* of a phase: those of the queue, and those of the queues before it."""
    before = 0
    for second, part, both in path:
        first = tokens * part // both
        before, tokens = (before + first, tokens - first) if second else (before, first)
    return tokens, before


def phases(totals: Mapping[str, int], weights: Mapping[str, float] | None = None) -> list[tuple]:
    """(queue, first token, tokens, tokens of all, stream position, path) of each queue and phase."""
    totals = {q: totals[q] for q in sorted(totals) if totals[q]}
    level = {q: 1 if weights is None else totals[q] / weights[q] for q in totals}
    done, rows, base = dict.fromkeys(totals, 0), [], 0
    for end in sorted(set(level.values())):
        upto = {q: totals[q] if level[q] <= end else min(totals[q], int(weights[q] * end)) for q in totals}
        size = {q: upto[q] - done[q] for q in totals if upto[q] > done[q]}
        whole, sizes = sum(size.values()), list(size.values())
        for i, (q, n) in enumerate(size.items()):
            rows.append((q, done[q], n, whole, base, halvings(sizes, i)))
        base, done = base + whole, upto
    return rows


_SEGMENT = "queue string, first bigint, size bigint, whole bigint, base bigint, path array<struct<second: boolean, part: bigint, both: bigint>>"


def _segments(tokens: DataFrame, weights: Mapping[str | None, float] | None) -> DataFrame:
    """One row per queue and phase."""
    totals = {r["queue"]: r["size"] for r in tokens.groupBy("queue").agg(F.sum("n").alias("size")).collect()}
    named = None
    if weights is not None:
        named = {"none" if s is None else f"source {s}": w for s, w in weights.items()}
        if any(w <= 0 for w in named.values()) or not totals.keys() <= named.keys():
            raise ValueError("every source needs a positive weight")
    return tokens.sparkSession.createDataFrame(phases(totals, named), _SEGMENT)


def places(
    start: int, length: int, segment: tuple[int, int, int, int, list[Halving]], window: int
) -> Iterator[tuple[int, int, int]]:
    """(token of the queue, tokens, stream position) of the runs of one document within one segment."""
    first, size, whole, base, path = segment
    position, end = max(start - first, 0), min(start + length - first, size)

    def own(k: int) -> int:
        return served(min(k * window, whole), path)[0]

    if position >= end:
        return
    k = position * whole // (size * window)
    while k and own(k) > position:
        k -= 1
    while own(k + 1) <= position:
        k += 1
    while position < end:
        begun, ahead = served(min(k * window, whole), path)
        upto, ahead_then = served(min((k + 1) * window, whole), path)
        n = min(upto, end) - position
        if n > 0:
            yield position + first, n, base + k * window + ahead_then - ahead + position - begun
            position += n
        k += 1


def sequence_cuts(position: int, length: int, total: int) -> Iterator[tuple[int, int, int]]:
    """(tokens, sequence, offset) of a run of the stream, cut where sequences end."""
    full = total // SEQUENCE
    while length:
        if position < full * SEQUENCE:
            number, offset, size = position // SEQUENCE, position % SEQUENCE, SEQUENCE
        else:
            # The rest of the stream: one sequence for each binary digit of its length, the largest first.
            rest, offset, number = total - full * SEQUENCE, position - full * SEQUENCE, full
            size = 1 << (rest.bit_length() - 1)
            while offset >= size:
                offset, rest, number = offset - size, rest - size, number + 1
                size = 1 << (rest.bit_length() - 1)
        n = min(length, size - offset)
        yield n, number, offset
        position, length = position + n, length - n


def pack(
    df: DataFrame,
    path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Mapping[str | None, float] | None = None,
    window: int = WINDOW,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, its ids."""
    kind = df.schema[doc_id].dataType.simpleString()
    tokens = _tokenized(df, path, doc_id, text, source)
    slim = tokens.select("row", "queue", "n")
    segments = stored(_segments(slim, weights), "packing-queues")
    queued = running_totals(slim, ["queue"], ["row"], {"start": "n"}, large=True, inclusive=False)
    # A document can cross the border of two phases, so it keeps the list of segments it touches.
    touched = queued.join(segments, "queue").filter(
        (F.col("start") < F.col("first") + F.col("size")) & (F.col("start") + F.col("n") > F.col("first"))
    )
    plan = touched.groupBy("row", "start").agg(F.sort_array(F.collect_list(F.struct("first", "size", "whole", "base", "path"))).alias("parts"))
    total = slim.agg(F.sum("n")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                yield _pieces(batch.slice(at, 128), window, total, with_ids)

    planned = tokens.join(plan, "row").select("doc_id", "start", "parts", "ids")
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return planned.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def _pieces(batch: pa.RecordBatch, window: int, total: int, with_ids: bool) -> pa.RecordBatch:
    owners, rows, kept = [], [], []
    for row, (start, parts, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
        ids = _wide(blob)
        data = memoryview(ids.tobytes())
        for part in parts:
            path = [(h["second"], h["part"], h["both"]) for h in part["path"]]
            segment = (part["first"], part["size"], part["whole"], part["base"], path)
            for place, length, position in places(start, len(ids), segment, window):
                at = place - start
                for n, number, offset in sequence_cuts(position, length, total):
                    owners.append(row)
                    rows.append((at, n, zlib.crc32(data[4 * at : 4 * (at + n)]), len(ids), number, offset))
                    kept.append(ids[at : at + n])
                    at += n
    columns = [batch.column(0).take(pa.array(owners, pa.int64()))]
    table = np.array(rows, dtype=np.int64).reshape(len(rows), 6)
    columns += [pa.array(table[:, i]) for i in range(6)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        ends = np.concatenate([[0], np.cumsum(table[:, 1])]).astype(np.int32)
        values = np.concatenate(kept).astype(np.int32) if kept else np.zeros(0, np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


@query("op6_mixture_packing")
def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
