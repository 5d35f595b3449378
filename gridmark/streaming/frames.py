"""Live frames: stride, newest-only, synchronous ticks and first-writer-wins images.

The functions take a batch or streaming DataFrame unless said otherwise. Watermarks only bound state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def every_nth(frames: DataFrame, stride: int) -> DataFrame:
    """Frames 0, n, 2n ... of each source; stateless, since the index is part of the frame."""
    if stride < 1:
        raise ValueError(f"stride must be positive, got {stride}")
    return frames.filter(F.col("frame_idx") % stride == 0)


def newest(batch: DataFrame, keep: int = 1) -> DataFrame:
    """The newest pending frames per source of one micro-batch: 1 unbuffered, up to 30 buffered."""
    if keep == 1:
        row = F.struct(*[c for c in batch.columns if c != "source"])
        latest = batch.groupBy("source").agg(F.max_by(row, "frame_idx").alias("_row"))
        return latest.select("source", "_row.*")
    order = Window.partitionBy("source").orderBy(F.col("frame_idx").desc())
    return batch.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")


def ticks(frames: DataFrame, sources: int, watermark: str | None = None) -> DataFrame:
    """Ticks for which every source has a frame, as one row with the frames in source order.

    Sources count ticks from 0 without gaps, so complete ticks end with the shortest source. A source's first frame of a
    tick counts. On a stream give *watermark*: a tick is emitted as soon as its last source arrives, whatever the times of
    its frames, and its state is dropped when the watermark has passed them.
    """
    if watermark is not None:
        return _tick_stream(frames.withWatermark("ts", watermark), sources)
    first = frames.groupBy("tick", "source").agg(F.min("frame_idx").alias("frame_idx"))
    grouped = first.groupBy("tick").agg(F.array_sort(F.collect_list(F.struct("source", "frame_idx"))).alias("frames"))
    return grouped.filter(F.size("frames") == sources).select("tick", "frames")


# Frames, one per source, of the ticks that share a row of state; a call for a block costs about as much as one for a tick.
BLOCK_FRAMES = 4096


def _tick_stream(frames: DataFrame, sources: int) -> DataFrame:
    """Ticks in blocks of neighbours: every tick of a block has its own frames and its own time to be forgotten."""
    kinds = dict(frames.dtypes)
    columns = ["tick", "source", "frame_idx"]

    def complete(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        waiting, until = None, pd.Series(dtype="int64")
        if state.exists:
            *lists, known, times = (list(v) for v in state.get)
            waiting = pd.DataFrame(dict(zip(columns, lists, strict=True))) if lists[0] else None
            until = pd.Series(times, index=known, dtype="int64")
        closed = until.index if waiting is None else until.index[~until.index.isin(waiting["tick"])]
        # On a time-out nothing has arrived.
        for batch in () if state.hasTimedOut else batches:
            latest = batch.groupby("tick", dropna=False)["_ms"].max().clip(lower=now) + 1
            until = pd.concat([until, latest]) if len(until) else latest
            until = until.groupby(level=0, dropna=False).max()
            arrived = batch.loc[~batch["tick"].isin(closed), columns]
            waiting = arrived if waiting is None else pd.concat([waiting, arrived])
            waiting = waiting.drop_duplicates(["tick", "source"])
        until = until[until >= now]
        found = None
        if waiting is not None:
            waiting = waiting[waiting["tick"].isin(until.index)]
            full = waiting.groupby("tick", dropna=False)["source"].transform("size") == sources
            found, waiting = waiting[full].sort_values(["tick", "source"]), waiting[~full]
        if len(until) == 0:
            state.remove()
            return
        lists = [[]] * 3 if waiting is None else [_plain(waiting[c]) for c in columns]
        state.update((*lists, _plain(until.index.to_series()), until.tolist()))
        state.setTimeoutTimestamp(int(until.min()))
        if found is not None and len(found):
            names, numbers = (list(found[c].to_numpy().reshape(-1, sources)) for c in columns[1:])
            yield pd.DataFrame({"tick": found["tick"].to_numpy()[::sources], "names": names, "numbers": numbers})

    blocks = frames.select(
        F.expr(f"tick div {max(1, BLOCK_FRAMES // sources)}").alias("_block"), *columns, "ts",
        F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("_ms"),
    )
    lists = f"names array<{kinds['source']}>, numbers array<{kinds['frame_idx']}>"
    rows = blocks.groupBy("_block").applyInPandasWithState(
        complete,
        f"tick {kinds['tick']}, {lists}",
        f"ticks array<{kinds['tick']}>, {lists}, known array<{kinds['tick']}>, until array<bigint>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return rows.select("tick", F.arrays_zip(F.col("names").alias("source"), F.col("numbers").alias("frame_idx")).alias("frames"))


def _plain(column: pd.Series) -> list:
    """Python values; missing ones are None."""
    return column.astype(object).where(column.notna(), None).tolist()


class FirstRows(StatefulProcessor):
    """Lets the first row of a key through and remembers the key until the watermark passes that row's time plus *keep*."""

    def __init__(self, columns: list[str], keep_ms: int):
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "until bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            for _ in rows:
                pass
            return
        # Within one micro-batch the earliest row is first, ties by its other columns.
        first = None
        for batch in rows:
            order = sorted(range(len(batch)), key=lambda i: (batch["ts"].iat[i], _comparable(batch.iloc[i], self.columns)))
            best = batch.iloc[order[0]]
            if first is None or (best["ts"], _comparable(best, self.columns)) < (first["ts"], _comparable(first, self.columns)):
                first = best
        until = int(first["ts"].timestamp() * 1000) + self.keep_ms
        until = max(until, timerValues.getCurrentWatermarkInMs() + 1)
        self.seen.update((until,))
        self.handle.registerTimer(until)
        yield pd.DataFrame([first])[self.columns]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def _comparable(row: pd.Series, columns: list[str]) -> list[tuple]:
    """Values in column order, missing ones first, lists element by element."""

    def key(value) -> tuple:
        if isinstance(value, (list, tuple, np.ndarray)):
            return (1, [key(v) for v in value])
        return (0, 0) if value is None or value is pd.NaT or value != value else (1, value)

    return [key(row[c]) for c in columns]


def first_writer_wins(images: DataFrame, watermark: str | None = None, keep: str = "0 seconds") -> DataFrame:
    """One row per image, the first to arrive, whole. ``images`` carries its detections as an array, so images stay whole.

    In a batch, arrival is the order of ``ts``, ties by the row. On a stream (*watermark*), micro-batches arrive in their
    order and rows of one by ``ts``; rows older than the watermark are dropped, and an image is known as written until
    the watermark has passed its first row by *keep*, so the two together must exceed the longest delay between two
    writers. The stream needs the state store of :func:`gridmark.streaming.precision.use_rocksdb`.
    """
    if watermark is None:
        row = F.struct("ts", F.struct(*[c for c in images.columns if c not in ("image_id", "ts")]).alias("rest"))
        first = images.groupBy("image_id").agg(F.min(row).alias("_first"))
        return first.select("image_id", "_first.ts", "_first.rest.*").select(images.columns)
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return (
        images.withWatermark("ts", watermark)
        .groupBy("image_id")
        .transformWithStateInPandas(FirstRows(images.columns, keep_ms), images.schema, "Append", "EventTime")
    )
