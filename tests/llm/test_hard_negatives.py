import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmark.llm.hard_negatives import OP12_SQL, PackedBlock, mine_hard_negatives, op12_hard_negatives

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("reach,spread,rows,dims", [(256, 256, 2500, 7), (1, 3, 5, 64), (1 << 20, 1 << 20, 1030, 9), (1 << 26, 1 << 27, 40, 3), (0, 0, 3, 2), (9, 9, 4, 0)])
def test_packed_products_are_exact(reach, spread, rows, dims):
    draw = np.random.default_rng(rows)
    vectors = draw.integers(-spread, spread + 1, size=(rows, dims))
    for low in (0, -spread, spread // 2):  # fields of one sign need no bias, and others a large one
        block = PackedBlock(vectors + low, reach)
        for _ in range(5):
            anchor = draw.integers(-reach, reach + 1, size=dims)
            assert block.scores(anchor.tolist()).tolist() == ((vectors + low) @ anchor).tolist()


def brute_force(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    """(anchor, positive, rank, negative, scores) from all inner products; ids last where null."""
    good = []
    for at, (i, vector, label) in enumerate(rows):
        if label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            good.append((at, i, [int(np.floor(256 * x)) for x in vector], label))
    found = []
    first = lambda pairs, n: sorted(pairs, key=lambda p: (-p[0], p[1] is None, p[1] or 0))[:n]
    for at, i, vector, label in good:
        if i is None or not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(vector, v, strict=True)), j, k) for b, j, v, k in good if b != at and len(v) == len(vector)]
        for score, positive, _ in first([s for s in scored if s[2] == label], positives):
            band = [s for s in scored if s[2] != label and low * score <= 100 * s[0] <= high * score]
            found += [(i, positive, n, s[1], score, s[0]) for n, s in enumerate(first(band, negatives), 1)]
    return sorted(found, key=str)


def table(spark, rows):
    named = [(i, v, k, 3, "r") for i, v, k in rows]
    return spark.createDataFrame(named, "vec_id long, embedding array<double>, label int, row int, band string")


def mined(spark, rows, is_anchor, **options):
    out = mine_hard_negatives(table(spark, rows), is_anchor, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()), key=str)


def groups(seed, size=300, dims=6):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dims))
    return [(i, (centres[c := draw.integers(6)] + draw.normal(size=dims) * 0.3).tolist(), int(c) // 2) for i in range(size)]


@pytest.mark.parametrize("block_values", [1 << 20, 300])
def test_equals_brute_force(spark, block_values):
    rows = groups(1)
    got = mined(spark, rows, F.col("vec_id") % 7 == 0, block_values=block_values)
    assert got and got == brute_force(rows, lambda i: i % 7 == 0)


def test_ties_repeats_nulls_and_lengths(spark):
    rows = [(i, [0.5, 0.5], i % 2) for i in range(40)] + [(3, [0.5, 0.45], 1), (3, [0.5, 0.45], 1), (4, [0.5, 0.45], 1)]
    rows += [(None, [0.5, 0.5], 0), (None, [0.5, 0.45], 1), (50, [0.5, None], 0), (51, None, 0), (52, [0.1, 0.1], None)]
    rows += [(53, [float("nan"), 0.1], 0), (54, [float("inf"), 0.1], 1), (60, [1.0, 2.0, 3.0], 0), (61, [1.0, 2.0, 2.9], 0), (62, [1.0, 2.0, 2.5], 1)]
    rows += [(70, [], 0), (71, [], 0), (72, [], 1), (80, [0.0, 0.0], 0), (90, [-1.0, -1.0], 5), (91, [1.0, 1.0], 5)]
    random.Random(2).shuffle(rows)
    for block_values in (1 << 20, 16):
        got = mined(spark, rows, F.col("vec_id") % 2 == 0, block_values=block_values)
        assert got == brute_force(rows, lambda i: i % 2 == 0)
        assert {r[0] for r in got} >= {60, 70}


def test_one_label_for_most_rows_and_other_parameters(spark):
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(size=4).tolist(), 0 if i % 10 else 1 + i % 3) for i in range(400)]
    got = mined(spark, rows, F.col("vec_id") < 20, positives=3, negatives=2, low=50, high=120, block_values=200)
    assert got == brute_force(rows, lambda i: i < 20, 3, 2, 50, 120)


def test_empty_huge_and_single(spark):
    assert mined(spark, [(1, [0.1], 1)], F.col("vec_id") > 0) == []
    assert mine_hard_negatives(table(spark, [(1, [0.1], 1)]).limit(0), F.lit(True)).collect() == []
    rows = [(0, [1e30, 0.0], 1), (1, [1e6, 1e5], 1), (2, [1e6, 1e5], 1), (3, [9.5e5, 1e5], 0)]
    got = mined(spark, rows, F.lit(True))
    assert got == brute_force(rows[1:], lambda i: True) and got


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    result = con.execute(OP12_SQL)
    names = [d[0] for d in result.description]
    out = op12_hard_negatives(spark, FOLDER)
    assert out.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    got = sorted(map(tuple, out.select(names).collect()))
    assert got and got == sorted(result.fetchall())
