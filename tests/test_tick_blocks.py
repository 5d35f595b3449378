"""Ticks of a stream are kept in blocks; each tick of a block is completed and forgotten on its own."""

from pyspark.sql import functions as F

from gridmark.streaming import frames as sf


def _run(spark, path, batches, sources, watermark):
    kinds = "source long, tick long, frame_idx long, second long"
    for rows in batches:
        frame = spark.createDataFrame(rows, kinds).withColumn("ts", F.timestamp_seconds("second")).drop("second")
        frame.coalesce(1).write.mode("append").parquet(str(path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    query = (
        sf.ticks(stream, sources, watermark).writeStream.outputMode("append").format("parquet")
        .option("path", str(path / "out")).option("checkpointLocation", str(path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = spark.read.schema("tick long, frames array<struct<source: long, frame_idx: long>>").parquet(str(path / "out"))
    return sorted((r.tick, [tuple(f) for f in r.frames]) for r in found.collect()), query.recentProgress


def test_state_has_a_row_for_many_ticks(spark, tmp_path):
    """Source by source, with a frame that comes twice and a source that ends early."""
    batches = [[(s, t, 10 * t + s, 60) for t in range(3000 if s else 2900)] + [(s, 7, 5000 + s, 60)] for s in (1, 0, 2)]
    ticks, progress = _run(spark, tmp_path, batches, 3, "400 days")
    assert ticks == [(t, [(s, 10 * t + s) for s in range(3)]) for t in range(2900)]
    rows = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert 0 < max(rows) <= 10


def test_ticks_of_a_block_are_forgotten_on_their_own(spark, tmp_path):
    batches = [
        [(0, 0, 1, 0), (0, 1, 2, 5000)],
        [(0, 2, 3, 1000), (1, 2, 4, 1000)],
        [(0, 3, 5, 1100), (1, 3, 6, 1100)],
        [(1, 0, 7, 5200), (1, 1, 8, 5200), (1, 2, 9, 5200)],
    ]
    ticks, _ = _run(spark, tmp_path, batches, 2, "4500 seconds")
    # The frames of 5000 and later move the watermark past tick 0, which has lost its first frame when the second comes.
    assert ticks == [(1, [(0, 2), (1, 8)]), (2, [(0, 3), (1, 4)]), (3, [(0, 5), (1, 6)])]
