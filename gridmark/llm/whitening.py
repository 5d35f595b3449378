"""Embedding whitening by QDWH spectral divide and conquer.

The covariance of all vectors is summed in two passes: exact sums first, then products of centred vectors, a matrix per
task, added row by row in the tasks' order. Its components come from polar decompositions: the orthogonal polar factor of
the covariance minus a shift is the matrix sign, found by the QR-based, dynamically weighted Halley iteration; half of
it plus half the identity projects on the components above the shift. An orthonormal basis of that projector's range and
of its complement splits the covariance into two smaller ones, and so on until single components are left. A shift that
meets an eigenvalue yields no projector and is replaced by another.

Mean, components and scales, one small table for each vector length (LEAD rows as wide as a vector), go to all tasks;
every row is whitened there. All Spark holds on the driver is as wide as the vectors, never as long as the table.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped, and so are those with
entries beyond 2^50, whose whole numbers would not fit; vectors of each length are whitened among themselves; components
without variance have no rows, so equal or single vectors, and empty ones, have none; rows without id and rows that
repeat an id are rows of their own; a deviation that does not fit a long is null; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.llm.catalogue import query
from gridmark.llm.common import read_table, stored

SCALE, OFFSET = 1_024, 100_000
LEAD = 8
LARGEST = float(1 << 50)
# Rows that are multiplied at a time.
CHUNK = 4_096
EPS = np.finfo(float).eps
# Shifts tried after the median, in standard deviations of the eigenvalues from their mean.
_SHIFTS = (0.0, 0.05, -0.05, 0.11, -0.11, 0.23, -0.23, 0.47, -0.47)


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix; null directions stay (almost) null."""
    n = len(a)
    x = a / np.abs(a).sum(axis=1).max()
    # A lower bound of the singular values: that of the triangular factor's inverse.
    r = np.linalg.qr(x, mode="r")
    if np.abs(np.diag(r)).min() > EPS:
        low = 1 / np.linalg.norm(np.linalg.inv(r), "fro")
    else:
        low = EPS
    low = min(max(low, EPS), 1.0)
    identity = np.eye(n)
    for _ in range(12):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        root = np.sqrt(1 + d)
        weight = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * root))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, identity]))
        new = b / c * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x, "fro")
        low, x = min(1.0, low * (weight + b * low * low) / (1 + c * low * low)), new
        if 1 - low <= 10 * EPS and moved <= np.cbrt(EPS) * np.sqrt(n):
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[float, np.ndarray, int]:
    """What the halves still share, an orthonormal basis, and how many of its columns span the part above *shift*."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = round(float(np.trace(projector)))
    if not 0 < rank < n:
        return np.inf, projector, rank
    # Two steps of subspace iteration from the projector's longest columns.
    start = projector[:, np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")[:rank]]
    basis, _ = np.linalg.qr(projector @ start)
    basis, _ = np.linalg.qr(projector @ basis, mode="complete")
    return float(np.linalg.norm(basis[:, rank:].T @ a @ basis[:, :rank])), basis, rank


def spectral_parts(a: np.ndarray, tolerance: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and orthonormal eigenvectors (columns) of a symmetric matrix."""
    n = len(a)
    if tolerance is None:
        tolerance = EPS * np.linalg.norm(a, "fro")
    diagonal = np.diag(a).copy()
    if n == 1 or np.linalg.norm(a - np.diag(diagonal), "fro") <= tolerance:
        return diagonal, np.eye(n)
    if n == 2:
        angle = 0.5 * np.arctan2(2 * a[0, 1], a[0, 0] - a[1, 1])
        turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        return np.diag(turn.T @ a @ turn).copy(), turn
    mean = diagonal.mean()
    spread = np.sqrt(max(0.0, np.sum(a * a) / n - mean * mean))
    best = (np.inf, a, 0)
    for shift in (np.median(diagonal), *(mean + t * spread for t in _SHIFTS)):
        best = min(best, _split(a, shift), key=lambda s: s[0])
        if best[0] <= 8 * n * tolerance:
            break
    shared, basis, rank = best
    if not np.isfinite(shared):
        # All eigenvalues agree to the last digits, so any basis will do.
        return diagonal, np.eye(n)
    turned = basis.T @ a @ basis
    turned = (turned + turned.T) / 2
    parts = [spectral_parts(turned[s, s], tolerance) for s in (slice(rank), slice(rank, n))]
    values = np.concatenate([p[0] for p in parts])
    return values, np.hstack([basis[:, :rank] @ parts[0][1], basis[:, rank:] @ parts[1][1]])


def leading_components(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues above rounding errors, falling, and their unit eigenvectors as rows."""
    values, vectors = spectral_parts(covariance)
    order = np.argsort(-values, kind="stable")[:count]
    order = order[values[order] > 8 * len(values) * EPS * max(values.max(initial=0.0), 0.0)]
    rows = vectors[:, order].T
    return values[order], rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    vector = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return df.select(F.col(f"`{vec_id}`").alias("vec_id"), vector.alias("vector")).filter(finite)


def _by_length(batch: pa.RecordBatch, scale: int, offset: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, whole numbers) of a few rows at a time."""
    vectors = batch.column(batch.schema.get_field_index("vector"))
    lengths = np.diff(vectors.offsets.to_numpy())
    starts = vectors.offsets.to_numpy()[:-1]
    flat = np.floor(scale * vectors.values.to_numpy(zero_copy_only=False)).astype(np.int64) + offset
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        for at in range(0, len(places), CHUNK):
            some = places[at : at + CHUNK]
            yield int(length), some, flat[starts[some][:, None] + np.arange(length)]


def _sums(df: DataFrame, scale: int, offset: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sums per entry, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = {}, {}
        for batch in batches:
            for length, some, x in _by_length(batch, scale, offset):
                counts[length] = counts.get(length, 0) + len(some)
                own = x.sum(axis=0).astype(object) if np.abs(x).max(initial=0) < 1 << 50 else x.astype(object).sum(axis=0)
                sums[length] = sums.get(length, 0) + own
        columns = [list(counts), list(counts.values()), [[str(s) for s in sums[k]] for k in counts]]
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)],
            ["dims", "n", "sums"],
        )

    partial = df.select("vector").mapInArrow(run, "dims bigint, n bigint, sums array<string>")
    counted = partial.groupBy("dims").agg(F.sum("n").alias("n"))
    added = partial.select("dims", F.posexplode("sums").alias("at", "s")).groupBy("dims", "at")
    added = added.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).groupBy("dims")
    rows = counted.join(added.agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("sums")), "dims", "left")
    return {r["dims"]: (r["n"], [int(s["s"]) for s in r["sums"] or []]) for r in rows.collect()}


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in whole numbers of any size."""
    largest = n * (int(np.abs(x).max(initial=0)) + 1) + max((abs(s) for s in sums), default=0)
    if largest < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _added_rows(partial: DataFrame, schema: str) -> DataFrame:
    """Matrices ``dims, task, line, numbers`` added over the tasks, in the tasks' order."""

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        values = table["numbers"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        total = values[0].copy()
        for one in values[1:]:
            total += one
        return pa.table([[key[0].as_py()], [key[1].as_py()], [total.tolist()]], schema=pa.schema(
            [("dims", pa.int64()), ("line", pa.int64()), ("numbers", pa.list_(pa.float64()))]))

    return partial.groupBy("dims", "line").applyInArrow(add, schema)


def _products(df: DataFrame, scale: int, offset: int, centre, height) -> DataFrame:
    """Sums over all rows of the outer products of ``centre(length, x)``, as rows ``dims, line, numbers``."""
    schema = "dims bigint, line bigint, numbers array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in _by_length(batch, scale, offset):
                if height(length):
                    y = centre(length, x)
                    totals[length] = totals.get(length, 0.0) + y.T @ y
        task = TaskContext.get().partitionId()
        for length, total in totals.items():
            lines = len(total)
            columns = [pa.array([length] * lines), pa.array([task] * lines), pa.array(range(lines)), pa.array(total.tolist())]
            yield pa.record_batch(columns, ["dims", "task", "line", "numbers"])

    partial = df.select("vector").mapInArrow(run, "dims bigint, task bigint, line bigint, numbers array<double>")
    return _added_rows(partial, schema)


def _matrix(table: pa.Table) -> np.ndarray:
    return np.array(table.sort_by("line")["numbers"].to_pylist())


def whiten(
    df: DataFrame,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    components: int = LEAD,
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and leading component."""
    spark = df.sparkSession
    kind = df.schema[vec_id].dataType.simpleString()
    rows = _usable(df, vec_id, embedding)
    sums = _sums(rows, scale, offset)

    def decompose(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = _matrix(table)
        values, vectors = leading_components(total, components)
        trace = float(np.trace(total))
        named = {
            "dims": pa.array([key[0].as_py()] * len(values), pa.int64()),
            "component": pa.array(range(1, len(values) + 1), pa.int32()),
            "eigenvalue": pa.array(values, pa.float64()),
            "explained": pa.array(values / trace if len(values) else values, pa.float64()),
            "direction": pa.array(vectors.tolist(), pa.list_(pa.float64())),
        }
        return pa.table(named)

    def exact(length: int, x: np.ndarray) -> np.ndarray:
        # Centred in whole numbers, then divided, so each entry is rounded once; the divisor n of the covariance too.
        n, own = sums[length]
        return _centred(x, n, own).astype(float) / n / np.sqrt(n)

    covariance = _products(rows, scale, offset, exact, lambda length: length > 0)
    schema = "dims bigint, component int, eigenvalue double, explained double, direction array<double>"
    fitted = stored(covariance.groupBy("dims").applyInArrow(decompose, schema), "whitening-components").collect()
    lead: dict[int, list] = {}
    for r in sorted(fitted, key=lambda r: (r["dims"], r["component"])):
        lead.setdefault(r["dims"], []).append(r)
    turns = {k: (np.array([r["direction"] for r in v]), np.sqrt([r["eigenvalue"] for r in v])) for k, v in lead.items()}
    explained = {k: [r["explained"] for r in v] for k, v in lead.items()}
    # Mean, directions and scales of every length, in one broadcast.
    shared = spark.sparkContext.broadcast((sums, turns, explained))

    def whitened(length: int, y: np.ndarray) -> np.ndarray:
        n, (directions, roots) = shared.value[0][length][0], shared.value[1][length]
        return (y.astype(float) / n) @ directions.T / roots

    def project(length: int, x: np.ndarray) -> np.ndarray:
        return whitened(length, _centred(x, *shared.value[0][length]))

    def mean_part(length: int, x: np.ndarray) -> np.ndarray:
        return np.hstack([project(length, x), np.ones((len(x), 1))])

    # The last line holds the sums, so the mean that is left by rounding is known before the second pass centres on it.
    means = {}
    for r in _products(rows, scale, offset, mean_part, lambda length: length in shared.value[1]).collect():
        if r["line"] == len(r["numbers"]) - 1:
            means[r["dims"]] = np.array(r["numbers"][:-1]) / r["numbers"][-1]

    def left_over(length: int, x: np.ndarray) -> np.ndarray:
        return (project(length, x) - means[length]) / np.sqrt(shared.value[0][length][0])

    errors: dict[int, float] = {}
    for r in _products(rows, scale, offset, left_over, lambda length: length in shared.value[1]).collect():
        line = np.array(r["numbers"])
        line[r["line"]] -= 1
        errors[r["dims"]] = max(errors.get(r["dims"], 0.0), float(np.abs(line).max()))

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, some, x in _by_length(batch, scale, offset):
                if length not in shared.value[1]:
                    continue
                y = _centred(x, *shared.value[0][length])
                out = whitened(length, y)
                count = out.shape[1]
                fits = (y.astype(float) ** 2).sum(axis=1) < 9.2e18
                squares = [int(s) if ok else None for s, ok in zip((y * y).sum(axis=1), fits, strict=True)]
                columns = [
                    batch.column(0).take(pa.array(np.repeat(some, count))),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(some))),
                    pa.array(np.full(out.size, shared.value[0][length][0], np.int64)),
                    pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(len(some)), count))),
                    pa.array(out.ravel()),
                    pa.array(np.tile(shared.value[2][length], len(some))),
                    pa.array(np.full(out.size, errors[length])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the leading components."""
    return whiten(read_table(spark, sf_dir, "embeddings"))
