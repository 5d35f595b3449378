from gridmark import scale
from gridmark.plans.stream_queries import _land_images
from gridmark.streaming import evaluation as se


def test_a_micro_batch_has_a_file_for_every_task(spark, tmp_path):
    found = spark.createDataFrame([(i, 0, 0, 0.5, 0.0, 0.0, 9.0, 9.0) for i in range(400)],
                                  "image_id long, label long, det_idx long, score double, x1 double, y1 double, x2 double, y2 double")
    real = spark.createDataFrame([(i, 0, 0, 0.0, 0.0, 9.0, 9.0, False) for i in range(400)],
                                 "image_id long, label long, gt_idx long, x1 double, y1 double, x2 double, y2 double, iscrowd boolean")
    slices, path, sizes = scale.slice_count(spark), str(tmp_path / "images"), []
    stream = _land_images(se.pack_images(found, real), path, 2)
    assert len(list((tmp_path / "images").glob("*.parquet"))) >= slices

    def note(batch, _):
        sizes.append(batch.count())

    running = stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    running.awaitTermination()
    assert len(sizes) == 2 and sum(sizes) == 400
