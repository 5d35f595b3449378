import math
import random

import numpy as np
import pytest

from gridmark.llm.embedding_dedup import embedding_classes


def vectors(seed, groups=20, size=12, dims=24, cosine=(0.955, 0.999)):
    draw = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = draw.normal(size=dims)
        base /= np.linalg.norm(base)
        for _ in range(size):
            side = draw.normal(size=dims)
            side -= side @ base * base
            side /= np.linalg.norm(side)
            c = draw.uniform(*cosine)
            rows.append(((c * base + math.sqrt(1 - c * c) * side) * draw.uniform(0.1, 9)).tolist())
        rows.append(base.tolist())
        rows.append(base.tolist())
    random.Random(seed).shuffle(rows)
    return list(enumerate(rows))


def brute_force(rows):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), dtype=bool)
    good = [i for i in range(n) if ok[i] and rows[i][0] is not None]
    units = np.array([np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good])
    link[np.ix_(good, good)] = units @ units.T >= 0.95
    np.fill_diagonal(link, False)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(link), strict=True):
            low = min(label[i], label[j], key=lambda k: rows[k][0])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return [(d, int(link[i].sum()), d if d is None else rows[label[i]][0]) for i, (d, _) in enumerate(rows)]


def result(spark, rows, **options):
    df = spark.createDataFrame([(d, v, 1) for d, v in rows], "vec_id long, embedding array<double>, key int")
    out = embedding_classes(df, **options)
    got = out.collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None), got


@pytest.mark.parametrize("block", [4096, 5])
def test_links_and_classes_equal_brute_force(spark, block):
    rows = vectors(1)
    got, _ = result(spark, rows, block=block)
    assert got == sorted(brute_force(rows))


def test_recall_of_pairs_at_the_threshold(spark):
    rows = vectors(2, groups=150, size=2, dims=64, cosine=(0.951, 0.96))
    got, _ = result(spark, rows)
    want = sorted(brute_force(rows))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("cosine", [(0.975, 0.98), (0.99, 0.999)])
def test_recall_in_a_dense_group_of_a_third(spark, cosine):
    # One group of different vectors among vectors without links; unthinned, a third of the pivots lie inside it.
    draw = np.random.default_rng(3)
    rows = [v for _, v in vectors(3, groups=1, size=2000, dims=64, cosine=cosine)]
    rows += draw.normal(size=(4000, 64)).tolist()
    rows = [(i, rows[k]) for i, k in enumerate(draw.permutation(len(rows)).tolist())]
    got, _ = result(spark, rows, block=700)
    units = np.array([v for _, v in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    want = (units @ units.T >= 0.95).sum(axis=1) - 1
    assert want.sum() > 2_000_000
    assert sum(g[1] for g in got) >= 0.95 * want.sum()
    assert all(g[1] <= w for g, w in zip(got, want.tolist(), strict=True))
    low = min(g[0] for g, w in zip(got, want.tolist(), strict=True) if w)
    assert sum(g[2] == low for g in got) >= 0.95 * (want > 0).sum()


def test_vectors_of_every_length_meet_their_like(spark):
    parts = [vectors(5, groups=8), vectors(6, groups=1, size=5, dims=10), vectors(7, groups=9, dims=31), [(0, [2.0])]]
    rows = [v for part in parts for _, v in part]
    rows = [(i, rows[k]) for i, k in enumerate(np.random.default_rng(5).permutation(len(rows)).tolist())]
    got, _ = result(spark, rows)
    want = {}
    for width in {len(v) for _, v in rows}:
        want |= {r[0]: r for r in brute_force([(i, v) for i, v in rows if len(v) == width])}
    assert got == [want[i] for i, _ in rows]


def test_odd_vectors(spark):
    rows = [
        (5, [1.0, 0.0, 0.5]), (3, [2.0, 0.0, 1.0]), (9, [1.0, 0.0, 0.5]), (1, None), (2, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.5]),
        (6, [float("nan"), 0.0, 1.0]), (7, [float("inf"), 0.0, 1.0]), (None, [1.0, 0.0, 0.5]), (8, [0.0, 1.0, 0.0]),
        (10, [1e-300, 0.0, 5e-301]),
    ]
    got, everything = result(spark, rows)
    by = {r[0]: r[1:] for r in got}
    assert by[5] == by[9] == by[3] == by[10] == (3, 3)
    assert all(by[k] == (0, k) for k in (1, 2, 4, 6, 7, 8))
    assert len(everything) == len(rows)
    assert result(spark, [(1, None), (2, None)])[0] == [(1, 0, 1), (2, 0, 2)]
