from pyspark.sql import functions as F

from gridmark.streaming import frames as sf
from gridmark.streaming.precision import use_rocksdb

SCHEMA = "image_id long, second long, writer string, boxes array<double>"


def stream_of(spark, tmp_path, batches, watermark, keep="0 seconds"):
    use_rocksdb(spark)
    for rows in batches:
        frame = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("second"))).drop("second")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        sf.first_writer_wins(stream, watermark, keep).writeStream.outputMode("append").format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert query.exception() is None
    return sorted((r.image_id, r.writer, r.boxes) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_whole_rows_of_first_writers(spark, tmp_path):
    batches = [
        [(1, 10, "a", [1.0, 2.0]), (1, 9, "b", [3.0]), (1, 9, "a", None), (2, 10, "a", [])],
        [(1, 5, "late", [9.0]), (3, 20, "c", [4.0, 4.0])],  # earlier in time, later to arrive
        [(3, 20, "d", None), (4, 21, "d", [1.0])],
    ]
    got = stream_of(spark, tmp_path, batches, "1 minute")
    assert got == [(1, "a", None), (2, "a", []), (3, "c", [4.0, 4.0]), (4, "d", [1.0])]


def test_late_second_writers_are_dropped_and_state_goes(spark, tmp_path):
    """The watermark moves to 990: rows before are dropped, and image 1, kept until 110, may be written anew."""
    batches = [[(1, 10, "a", None), (2, 950, "a", None)], [(9, 1000, "z", None)], [(8, 1001, "z", None)], [(1, 20, "late", None), (2, 995, "b", None), (1, 1002, "new", None)]]
    got = stream_of(spark, tmp_path, batches, "10 seconds", "100 seconds")
    assert got == [(1, "a", None), (1, "new", None), (2, "a", None), (8, "z", None), (9, "z", None)]
    state = spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "state"))
    assert {r.key.image_id for r in state.collect()} == {1, 2, 8, 9}


def test_batch_form_takes_the_earliest(spark):
    rows = spark.createDataFrame([(1, 10, "b", None), (1, 10, "a", [1.0]), (2, 3, "x", None)], SCHEMA).withColumnRenamed("second", "ts")
    assert sorted((r.image_id, r.writer) for r in sf.first_writer_wins(rows).collect()) == [(1, "a"), (2, "x")]
