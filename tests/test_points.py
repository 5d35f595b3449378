from pyspark.sql import functions as F

from gridmark.operators import transforms as tr

KIND = "width int, height int, x1 double, y1 double, x2 double, y2 double, area double, keypoints array<double>"


def test_points_are_computed_once_and_short_lists_stay(spark):
    box = (0.0, 0.0, 4.0, 4.0, 16.0)
    points = [[1.0, 2.0, 2.0, 3.0, 4.0, 1.0, 5.0, 6.0, 2.0], [1.0, 2.0, 2.0, 3.0], [1.0, 2.0, 0.0, 30.0, 4.0, 1.0], [], None, [1.0, None, 2.0]]
    targets = spark.createDataFrame([(10, 20, *box, p) for p in points], KIND)
    # A list named inside a lambda over itself would be made again for each of its entries.
    flipped = tr.flip(targets, pairs=[1, 2])
    plan = flipped._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(transform(" not in plan
    got = [r.keypoints for r in flipped.collect()]
    assert got[0] == [9.0, 2.0, 2.0, 5.0, 6.0, 2.0, 7.0, 4.0, 1.0]
    assert got[1] == [9.0, 2.0, 2.0, 0.0] and got[2] == [0.0] * 6 and got[3] == [] and got[4] is None and got[5] == [0.0] * 3
    half = [r.keypoints for r in tr.resize(targets, F.lit(10), F.lit(5)).collect()]
    assert half[0] == [0.5, 1.0, 2.0, 1.5, 2.0, 1.0, 2.5, 3.0, 2.0] and half[1] == [0.5, 1.0, 2.0, 0.0] and half[3] == [] and half[4] is None
