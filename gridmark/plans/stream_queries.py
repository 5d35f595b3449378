"""Streaming forms run to completion over the tables; each must equal its batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmark import scale
from gridmark.operators import average_precision as ap
from gridmark.operators import matching as mt
from gridmark.operators.sweep import score_bins
from gridmark.plans import matching_queries as mq
from gridmark.plans import precision_queries as pq
from gridmark.plans.fixtures import read, view, with_views
from gridmark.plans.registry import query
from gridmark.streaming import evaluation as se
from gridmark.streaming import frames as sf
from gridmark.streaming import precision as sp


def _land_images(images, path: str, batches: int):
    """Whole-image rows added to *path* and read back as a stream of *batches* micro-batches; each has a file for every task."""
    spark = images.sparkSession
    files = -(-scale.slice_count(spark) // batches)
    images.repartition(files * batches).write.mode("append").parquet(path)
    return spark.readStream.schema(se.IMAGE_ROWS).option("maxFilesPerTrigger", files).parquet(path)


def _finish(writer) -> None:
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()


@query("streamed_matching", mq._sql(
    """select label, t.total_gt, count(*) filter (is_tp) as tp, count(*) filter (is_ignored) as ignored, count(*) as n
       from matched join totals t using (label) group by 1, 2""", mq.MATCHED))  # fmt: skip
def streamed_matching(spark, folder):
    out = scale.run_folder(spark, "streamed")
    images = se.pack_images(view(spark, folder, "det"), view(spark, folder, "gt"))
    _finish(se.match_stream(_land_images(images, scale.run_folder(spark, "images"), 2), out, f"{out}/checkpoint"))
    matched, counts = se.matched_so_far(spark, out)
    rows = matched.groupBy("label").agg(
        F.count_if("is_tp").alias("tp"), F.count_if("is_ignored").alias("ignored"), F.count("*").alias("n")
    )
    return rows.join(counts, "label")


@query("streamed_box_statistics", pq._sql(" select statistic, round(value, 9) as value from stats", pq.STATISTICS))
def streamed_box_statistics(spark, folder):
    """Five micro-batches of images; the stream ends after the first three and is started again for the others."""
    sp.use_rocksdb(spark)
    path, checkpoint = scale.run_folder(spark, "images"), scale.run_folder(spark, "curves")
    images = se.pack_images(view(spark, folder, "det"), view(spark, folder, "gt"))
    for half, batches in ((0, 3), (1, 2)):
        landed = images.filter(F.pmod(F.xxhash64("image_id"), F.lit(2)) == half)
        _finish(sp.precision_stream(_land_images(landed, path, batches), checkpoint))
    result = sp.precision_so_far(spark, checkpoint)
    return ap.summarize_boxes(result).withColumn("value", F.round("value", 9))


@query("streamed_running_bins", mq._sql(
    f""", {mq.SWEEP} select m.label, (select count(*) from grid g where g.threshold <= m.score::double)::int as bin,
          count(*) filter (is_tp) as tp, count(*) filter (not is_tp) as fp
        from matched m where not is_ignored group by all""", mq.MATCHED))  # fmt: skip
def streamed_running_bins(spark, folder):
    """Counters of a stream of matched rows, kept as classes x bins of state."""
    source, out = scale.run_folder(spark, "matched"), scale.run_folder(spark, "bins")
    matched = mq.matched(spark, folder)
    matched.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(matched.schema).option("maxFilesPerTrigger", 2).parquet(source)

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(f"{out}/latest")

    writer = se.running_bins(stream).writeStream.outputMode("complete").foreachBatch(keep)
    _finish(writer.option("checkpointLocation", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/latest")


def _either(folder: str, name: str) -> str:
    """A table that is one file or a folder of them: a stream takes a single file only as a pattern."""
    return f"{folder}/{name}.parque[t]"


def _frames(spark, folder):
    """Live frames: an event is a frame of its type's source."""
    schema = read(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).parquet(_either(folder, "events"))
    return stream.select(F.col("event_type").alias("source"), F.col("event_id").alias("frame_idx"), "ts")


def _landed(stream, spark, name, mode="append"):
    out = scale.run_folder(spark, name)
    _finish(stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").format("parquet").option("path", f"{out}/rows"))
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("frame_stride", "select event_type as source, event_id as frame_idx from events where event_id % 3 = 0")
def frame_stride(spark, folder):
    return _landed(sf.every_nth(_frames(spark, folder), 3).select("source", "frame_idx"), spark, "stride")


@query("newest_frames", """
    select event_type as source, event_id as frame_idx, 'buffered' as mode from (
      select *, row_number() over (partition by event_type order by event_id desc) as n from events) where n <= 30
    union all select event_type, max(event_id), 'newest' from events group by 1""")  # fmt: skip
def newest_frames(spark, folder):
    """The newest frames with and without buffering: every micro-batch keeps its own, the last step the newest of those."""
    out = scale.run_folder(spark, "newest")

    def keep(batch, batch_id):
        parts = [sf.newest(batch, n).withColumn("mode", F.lit(mode)) for n, mode in ((30, "buffered"), (1, "newest"))]
        parts[0].unionByName(parts[1]).write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    frames = _frames(spark, folder).select("source", "frame_idx")
    _finish(frames.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint"))
    rows = spark.read.parquet(f"{out}/rows").drop("batch")
    parts = [sf.newest(rows.filter(F.col("mode") == mode).drop("mode"), n).withColumn("mode", F.lit(mode))
             for n, mode in ((30, "buffered"), (1, "newest"))]
    return parts[0].unionByName(parts[1])


@query("synchronous_ticks", """
    with f as (select event_id % 4 as source, (event_id - event_id % 4) / 4 as tick, event_id from events
               where not (event_id % 4 = 2 and event_id > (select max(event_id) * 0.8 from events)))
    select cast(tick as bigint) as tick, min(event_id) as first_frame, max(event_id) as last_frame from f group by 1 having count(*) = 4""")  # fmt: skip
def synchronous_ticks(spark, folder):
    """Four sources, one of which ends early."""
    events = read(spark, folder, "events")
    limit = events.agg((F.max("event_id") * 0.8).alias("n")).scalar()
    source = F.col("event_id") % 4
    frames = events.filter(~((source == 2) & (F.col("event_id") > limit))).select(
        source.alias("source"), ((F.col("event_id") - source) / 4).cast("long").alias("tick"), F.col("event_id").alias("frame_idx")
    )
    rows = sf.ticks(frames, 4)
    return rows.select(
        "tick", F.get("frames", 0)["frame_idx"].alias("first_frame"), F.element_at("frames", -1)["frame_idx"].alias("last_frame")
    )


@query("first_writer_wins", """
    select user_id as image_id, ts, event_id, value from events qualify row_number() over (partition by user_id order by ts, event_id) = 1""")  # fmt: skip
def first_writer_wins(spark, folder):
    """The whole first row of each image from a stream whose micro-batches arrive in the order of time."""
    sp.use_rocksdb(spark)
    path = scale.run_folder(spark, "writers")
    rows = read(spark, folder, "events").select(F.col("user_id").alias("image_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    week = F.floor((F.dayofmonth("ts") - 1) / 8)
    for number in range(4):  # files are taken by their age
        rows.filter(week == number).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _landed(sf.first_writer_wins(stream, "40 days"), spark, "first")


_TICKS = """
    with f as (select event_id % 4 as source, (event_id - event_id % 4) / 4 as tick, event_id from events
               where not (event_id % 4 = 2 and event_id > 900000000))
    select cast(tick as bigint) as tick, min(event_id) as first_frame, max(event_id) as last_frame from f group by 1 having count(*) = 4"""


@query("streamed_ticks", _TICKS)
def streamed_ticks(spark, folder):
    """Ticks of four sources from a stream in several micro-batches; frames of a tick may be far apart in time."""
    source = F.col("event_id") % 4
    path = scale.run_folder(spark, "ticks")
    rows = read(spark, folder, "events").select(
        source.alias("source"), ((F.col("event_id") - source) / 4).cast("long").alias("tick"),
        F.col("event_id").alias("frame_idx"), F.col("ts").cast("timestamp").alias("ts"),
    )
    files = -(-scale.slice_count(spark) // 4)  # of a micro-batch
    for number in range(4):  # files are taken by their age
        rows.filter(source == number).repartition(files, "tick").write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    found = _landed(sf.ticks(stream, 4, "400 days"), spark, "ticks-out")
    return found.select(
        "tick", F.get("frames", 0)["frame_idx"].alias("first_frame"), F.element_at("frames", -1)["frame_idx"].alias("last_frame")
    )


@query("first_writer_rows", """
    select user_id as image_id, event_id from events qualify row_number() over (partition by user_id order by ts, event_id) = 1""")  # fmt: skip
def first_writer_rows(spark, folder):
    """The whole first row of each image, by arrival."""
    images = read(spark, folder, "events").select(F.col("user_id").alias("image_id"), "ts", "event_id")
    return sf.first_writer_wins(images).drop("ts")


@query("score_bin_counts", mq._sql(
    f""", {mq.SWEEP} select m.label, (select count(*) from grid g where g.threshold <= m.score::double)::int as bin,
          count(*) filter (is_tp) as tp, count(*) filter (not is_tp) as fp
        from matched m where not is_ignored group by all""", mq.MATCHED))  # fmt: skip
def score_bin_counts(spark, folder):
    return score_bins(mt.merge_matched(mq.matched(spark, folder)))
