import os

import numpy as np
import pytest

from gridmark.llm.whitening import leading_components, op13_whitening, polar_factor, spectral_parts, whiten

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def symmetric(n, kind, draw):
    x = draw.normal(size=(3 * n, n))
    if kind == "null block":
        x[:, n // 2 :] = 0
    if kind == "graded":
        x = x * np.logspace(0, -6, n)
    if kind == "multiple":
        q, _ = np.linalg.qr(draw.normal(size=(n, n)))
        return q @ np.diag(np.resize([1.0, 2.0, 3.0], n)) @ q.T
    return {"identity": np.eye(n) * 2.5, "ones": np.ones((n, n)), "indefinite": x[:n] + x[:n].T}.get(kind, x.T @ x)


@pytest.mark.parametrize("kind", ["full", "null block", "graded", "multiple", "identity", "ones", "indefinite"])
@pytest.mark.parametrize("n", [1, 2, 3, 9, 40])
def test_parts_are_the_spectrum(n, kind):
    a = symmetric(n, kind, np.random.default_rng(n))
    a = (a + a.T) / 2
    values, vectors = spectral_parts(a)
    size = np.linalg.norm(a)
    assert np.abs(np.sort(values) - np.linalg.eigvalsh(a)).max() <= 1e-14 * size
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() <= 1e-13
    assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-13 * size


def test_polar_factor_is_the_sign():
    draw = np.random.default_rng(4)
    q, _ = np.linalg.qr(draw.normal(size=(12, 12)))
    values = np.array([-3, -1, -0.5, -1e-3, -1e-9, 1e-9, 1e-4, 0.1, 1, 2, 5, 100.0])
    a = q @ np.diag(values) @ q.T
    assert np.abs(polar_factor((a + a.T) / 2) - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-5
    assert leading_components(np.diag([1.0, 4.0, 0.0]), 3)[0].tolist() == [4.0, 1.0]


def brute_force(vectors, components=8):
    """Exact sums by Python's whole numbers, eigenvectors by the linear algebra library."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    y = [[n * c - s for c, s in zip(row, sums, strict=True)] for row in x]
    centred = np.array([[float(c) for c in row] for row in y]) / n
    covariance = centred.T @ centred / n
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    order = [k for k in order if values[k] > 1e-12 * values.max()]
    out = centred @ columns[:, order] / np.sqrt(values[order])
    return n, [sum(c * c for c in row) for row in y], out, values[order] / np.trace(covariance)


def agree(rows, vectors, ids):
    n, deviation, out, explained = brute_force(vectors)
    place = {i: k for k, i in enumerate(ids)}
    assert len(rows) == out.size
    found = np.full(out.shape, np.nan)
    for r in rows:
        k, c = place[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == (deviation[k] if deviation[k] < 2**63 else None)
        assert abs(r.explained - explained[c]) <= 1e-9 * explained[c] and 0 <= r.identity_error <= 1e-8
        found[k, c] = r.whitened
    signs = np.sign((found * out).sum(axis=0))
    assert np.abs(found * signs - out).max() < 1e-6
    assert len({r.identity_error for r in rows}) == 1
    assert np.abs(np.cov(found.T, bias=True) - np.eye(found.shape[1])).max() < 1e-8


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, dims string")


@pytest.mark.parametrize("dims", [3, 8, 20])
def test_equals_brute_force(spark, dims):
    draw = np.random.default_rng(dims)
    vectors = (draw.normal(size=(500, dims)) @ draw.normal(size=(dims, dims)) + 3).astype(np.float32)
    vectors[100:300] = vectors[0]  # one vector on two fifths of the rows
    out = whiten(table(spark, [(i, v.tolist()) for i, v in enumerate(vectors)]))
    assert out.columns == COLUMNS
    agree(out.collect(), vectors, range(500))


def test_nulls_repeats_lengths_and_no_variance(spark):
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(60, 3)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan")] * 3), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1e30, 0.0, 0.0])]
    odd += [(106, [1.0, 2.0]), (107, [1.0, 2.0]), (108, [5.0])]
    agree(whiten(table(spark, rows + odd)).collect(), vectors, range(60))
    flat = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]
    got = whiten(table(spark, flat)).collect()
    assert len(got) == 10 and {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)
    assert len(whiten(table(spark, [(None, v) for _, v in rows] + [(7, rows[0][1])] * 2)).collect()) == 62 * 3
    empty = whiten(table(spark, rows).limit(0))
    assert empty.collect() == [] and empty.columns == COLUMNS


def test_two_lengths_are_whitened_apart_and_large_numbers_stay_exact(spark):
    draw = np.random.default_rng(2)
    short, long = draw.normal(size=(40, 2)).astype(np.float32), (draw.normal(size=(30, 4)) * 1e6).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(short)] + [(100 + i, v.tolist()) for i, v in enumerate(long)]
    got = whiten(table(spark, rows)).collect()
    agree([r for r in got if r.vec_id < 100], short, range(40))
    agree([r for r in got if r.vec_id >= 100], long, range(100, 130))
    huge = (draw.normal(size=(30, 2)) * 1e14).astype(np.float32)
    got = whiten(table(spark, [(i, v.tolist()) for i, v in enumerate(huge)])).collect()
    assert len(got) == 60 and all(r.deviation is None for r in got)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_query_over_the_whole_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    out = op13_whitening(spark, FOLDER)
    assert [k for _, k in out.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    agree(out.collect(), [r.embedding for r in rows], [r.vec_id for r in rows])
