import math
import random

import pytest
from pyspark.sql import functions as F

from gridmark.operators import runs as rn


def slow_smooth(rows, alpha):
    out, last = {}, {}
    for run, epoch, value in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] is not None, r[2])):
        before = last.get(run, 0.0)
        last[run] = None if before is None or value is None else before * alpha + value * (1 - alpha)
        out.setdefault((run, epoch), []).append(last[run])
    return {k: sorted(v, key=lambda x: (x is None, x)) for k, v in out.items()}


@pytest.mark.parametrize("alpha,limit", [(0.0, 50), (0.5, 50), (0.97, 0), (1.0, 50), (0.7, 100_000)])
def test_smoothing_in_ranges_equals_one_fold(spark, monkeypatch, alpha, limit):
    monkeypatch.setattr(rn, "RANGE_ROWS", limit)
    draw = random.Random(4)
    rows = [("long", i, draw.uniform(-5, 9)) for i in range(900)] + [(None, i, draw.random()) for i in range(40)]
    rows += [("gap", i, None if i == 7 else 1.0 * i) for i in range(30)] + [("twice", i // 2, draw.random()) for i in range(20)] + [("one", 3, 2.0)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, epoch int, value double")
    got = {}
    for r in rn.smooth(df, ["run"], alpha).collect():
        got.setdefault((r.run, r.epoch), []).append(r.smoothed)
    want = slow_smooth(rows, alpha)
    assert got.keys() == want.keys()
    for key, values in want.items():
        found = sorted(got[key], key=lambda x: (x is None, x))
        assert [v is None for v in found] == [v is None for v in values]
        assert [v for v in found if v is not None] == pytest.approx([v for v in values if v is not None], abs=1e-12)
    assert {r.epoch for r in rn.smooth(df, ["run"], alpha, skip_epochs=890).collect()} == set(range(890, 900))


def test_a_run_of_a_million_steps(spark):
    """One run is many tasks; no row holds a list of its steps."""
    df = spark.range(1_000_000).selectExpr("'r' AS run", "CAST(id AS INT) AS epoch", "CAST(id % 1000 AS DOUBLE) AS value")
    smoothed = rn.smooth(df, ["run"], 0.9).filter("epoch % 99999 = 5 OR epoch = 999999")
    last, want = 0.0, {}
    for i in range(1_000_000):
        last = last * 0.9 + (i % 1000) * (1 - 0.9)
        if i % 99999 == 5 or i == 999_999:
            want[i] = last
    assert {r.epoch: r.smoothed for r in smoothed.collect()} == pytest.approx(want, rel=1e-12)
    rising = df.select("run", "epoch", F.col("epoch").cast("double").alias("regular"), F.lit(None).cast("double").alias("ema"))
    row = rn.early_stop(rising, ["run"]).first()
    assert (row.best, row.stopped_epoch) == (999_999.0, None)


def slow_stop(rows, patience, min_delta, use_ema, skip):
    out = {}
    for run in {r[0] for r in rows}:
        best, waited, stopped, any_value = -math.inf, 0, None, False
        usable = []
        for _, epoch, regular, ema in (r for r in rows if r[0] == run and r[1] >= skip):
            both = [v for v in (regular, ema) if v is not None]
            larger = None if not both else float("nan") if any(math.isnan(v) for v in both) else max(both)
            value = ema if use_ema and ema is not None else larger
            if value is not None:
                usable.append((epoch, value))
        for epoch, value in sorted(usable, key=lambda e: e[0]):
            any_value = True
            if stopped is None:
                better = math.isfinite(value) and value - min_delta > best
                best, waited = (value, 0) if better else (best, waited + 1)
                if not math.isfinite(value) or (not better and waited >= patience):
                    stopped = epoch
        if any_value:
            out[run] = (best, stopped)
    return out


@pytest.mark.parametrize("use_ema,skip", [(False, 0), (True, 3)])
def test_early_stopping_equals_the_rule(spark, use_ema, skip):
    draw = random.Random(9)
    rows = []
    for run in range(60):
        level = 0.0
        for epoch in range(draw.randrange(0, 40)):
            level += draw.choice([0.0, 0.0005, 0.002, 0.1, -0.1])
            value = draw.choice([level, level, level, None if run % 5 == 0 else level, float("nan") if run % 9 == 1 and epoch > 20 else level])
            rows.append((f"r{run}" if run else None, epoch, value, draw.choice([None, level + 0.01, level - 0.3])))
    rows.append(("inf", 5, float("inf"), None))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, epoch int, regular double, ema double")
    options = {"patience": 4, "min_delta": 0.001, "use_ema": use_ema, "skip_epochs": skip}
    got = {r.run: (r.best, r.stopped_epoch) for r in rn.early_stop(df, ["run"], **options).collect()}
    assert got == slow_stop(rows, 4, 0.001, use_ema, skip)
    assert rn.early_stop(df.limit(0), ["run"]).collect() == [] and rn.smooth(df.limit(0).selectExpr("run", "epoch", "regular AS value"), ["run"], 0.5).collect() == []
