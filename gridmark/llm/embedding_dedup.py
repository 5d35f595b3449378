"""Embedding near-dedup by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, thinned so that no two lie close to each other: a dense
group gets few pivots whatever its size, so its members see the same ones. A vector is described by its nearest pivots in order;
near vectors see nearly the same ones. The index has inverted lists over pivots, kept for every three pivots of a
description at once, so that a list holds just the vectors that share these three: two vectors meet when their shared
pivots number three or more. Pairs that meet are verified by cosine in double precision; a pair is counted only in the
list of its three smallest shared pivots, so each link counts once, and rows whose pairs count elsewhere are not multiplied.

Equal vectors are one class from the start. Lists are compared in blocks by matrix products inside a task; only link
counts and a spanning tree of each list's links leave it, so no task emits all pairs of a group. Lists longer than a
block are dealt as pairs of blocks to tasks of their own.

Recall is that of meeting in three of the nearest PREFIX pivots; the tests measure it against brute force. No link below
the threshold is returned.

Every vector length has pivots and lists of its own, so vectors meet those of their length; a length of few vectors is
one list.

Defined results: vectors that are null, zero or empty, or that hold null or non-finite components, link with nothing and are their own component; a row without id links with nothing and has no component; rows that repeat an id
are vectors of their own; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmark.llm.catalogue import query
from gridmark.llm.common import read_table, stored
from gridmark.llm.components import components

THRESHOLD = 0.95
# Documented bound of the sample that fits the index, and length of the descriptions.
PIVOTS = 512
SAMPLE = 4 * PIVOTS
# A sampled vector with this cosine or more to a pivot is not a pivot itself.
APART = 0.8
PREFIX = 8
SHARED = 3
# Members of a list that one task compares at once.
BLOCK = 4_096
SMALL = 64
_TRIPLES = np.array(list(combinations(range(PREFIX), SHARED)))


def _rows(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, vector, cid``; cid is null where a row links with nothing."""
    vector = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(f"`{vec_id}`").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)
    # Adding zero makes the two zeros one.
    vector = F.transform(vector, lambda x: x + F.lit(0.0))
    rows = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.when(usable, vector).alias("vector"))
    return rows.withColumn("cid", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))


def _classes(rows: DataFrame) -> DataFrame:
    """``cid, low, copies, vector`` of the distinct usable vectors."""
    rows = rows.filter("cid is not null")
    return rows.groupBy("cid", "vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))


def _unit(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return _normalised(flat.reshape(len(values), -1))


def _normalised(vectors: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps tiny and huge vectors in range.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def thinned(units: np.ndarray) -> np.ndarray:
    """The first PIVOTS of *units* of which none lies close to an earlier one."""
    kept = np.zeros((0, units.shape[1]))
    for at in range(0, len(units), 64):
        chunk = units[at : at + 64]
        near = (chunk @ kept.T >= APART).any(axis=1)
        own = chunk @ chunk.T >= APART
        for i in range(len(chunk)):
            near[i] |= bool((own[i, :i] & ~near[:i]).any())
        kept = np.concatenate([kept, chunk[~near]])[:PIVOTS]
    return kept


def describe(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each vector, nearest first (equal ones by number)."""
    n = min(PREFIX, len(pivots))
    return np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, :n].astype(np.int64)


def _list_keys(described: np.ndarray) -> np.ndarray:
    """The lists of each vector within its length: every three of its pivots, smallest first, as one number."""
    ordered = np.sort(described, axis=1)
    if ordered.shape[1] < SHARED:
        # Too few pivots to share three: everything meets in one list.
        return np.zeros((len(ordered), 1), dtype=np.int64)
    triples = _TRIPLES[_TRIPLES.max(axis=1) < ordered.shape[1]]
    return (ordered[:, triples] * np.array([PIVOTS**2, PIVOTS, 1])).sum(axis=2)


def _smallest_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The list in which a pair counts; descriptions are sorted."""
    if a.shape[1] < SHARED:
        return np.zeros(len(a), dtype=np.int64)
    common = (a[:, :, None] == b[:, None, :]).any(axis=2)
    first = common & (np.cumsum(common, axis=1) <= SHARED)
    return (a[first].reshape(len(a), SHARED) * np.array([PIVOTS**2, PIVOTS, 1])).sum(axis=1)


def _pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """The pivots of each length that has more than SMALL vectors."""
    sizes = classes.groupBy(F.size("vector").alias("width")).count().filter(F.col("count") > SMALL)
    place = F.xxhash64("vector", F.lit(1))
    share = F.pmod(place, F.lit(2**31)) / F.lit(float(2**31))
    wide = classes.select("vector", "low", F.size("vector").alias("width"), place.alias("place"), share.alias("share"))
    # Pivots of each of these lengths are broadcast anyway.
    drawn = wide.join(F.broadcast(sizes), "width").filter(F.col("share") * F.col("count") < SAMPLE)
    by_width: dict[int, list] = {}
    for r in sorted(drawn.select("width", "place", "low", "vector").collect(), key=lambda r: (r.width, r.place, r.low)):
        by_width.setdefault(r.width, []).append(r.vector)
    return {width: thinned(_normalised(np.array(some))) for width, some in by_width.items()}


def _index(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``cid, copies, vector, pivots, keys``: unit vectors and sorted descriptions in bytes; keys begin with the length."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = whole.column(2).value_lengths().to_numpy()
            for width in np.unique(lengths).tolist():
                batch = whole.filter(pa.array(lengths == width))
                units = _unit(batch, 2)
                described = describe(units, shared.value.get(width, np.zeros((0, width))))
                keys = _list_keys(described) + width * PIVOTS**SHARED
                columns = [
                    batch.column(0),
                    batch.column(1),
                    pa.array([u.tobytes() for u in units], pa.binary()),
                    pa.array([d.astype("<i8").tobytes() for d in np.sort(described, axis=1)], pa.binary()),
                    pa.array(keys.tolist(), pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "copies", "vector", "pivots", "keys"])

    narrow = classes.select("cid", "copies", "vector")
    return narrow.mapInArrow(run, "cid bigint, copies bigint, vector binary, pivots binary, keys array<bigint>")


class _Members:
    """The rows of some lists of one vector length; their keys are without it."""

    def __init__(self, table: pa.Table):
        self.key = table["key"].to_numpy() % PIVOTS**SHARED
        self.part = table["part"].to_numpy()
        self.block = table["block"].to_numpy()
        self.cross = table["cross"].to_numpy(zero_copy_only=False)
        self.cid = table["cid"].to_numpy()
        self.copies = table["copies"].to_numpy()
        self.units = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(len(self.key), -1)
        self.pivots = np.frombuffer(b"".join(table["pivots"].to_pylist()), "<i8").reshape(len(self.key), -1)

    def starts(self) -> np.ndarray:
        new = (self.key[1:] != self.key[:-1]) | (self.part[1:] != self.part[:-1])
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    def near_pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one list at or over the threshold, each in one list only, some at a time."""
        starts = self.starts()
        sizes = np.diff(np.append(starts, len(self.key)))
        for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
            i, j = np.triu_indices(size, 1)
            groups = starts[sizes == size]
            step = max(1, 200_000 // len(i))
            for at in range(0, len(groups), step):
                base = groups[at : at + step, None]
                a, b = (base + i).ravel(), (base + j).ravel()
                near = np.einsum("ij,ij->i", self.units[a], self.units[b]) >= threshold
                near &= ~self.cross[a] | (self.block[a] != self.block[b])
                a, b = a[near], b[near]
                here = _smallest_shared(self.pivots[a], self.pivots[b]) == self.key[a]
                yield a[here], b[here]
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            yield from self._near_in(start, size, threshold)

    def _near_in(self, start: int, size: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of one long list; rows whose pairs count in another list are not multiplied."""
        pivots = self.pivots[start : start + size]
        shared = [self.key[start] // PIVOTS**2, self.key[start] // PIVOTS % PIVOTS, self.key[start] % PIVOTS]
        if pivots.shape[1] < SHARED:
            pivots = pivots[:, :0]
        # A pair that shares one more pivot before the list's third counts in that one's list.
        rows, at = np.nonzero((pivots < shared[2]) & (pivots != shared[0]) & (pivots != shared[1]))
        names, column = np.unique(pivots[rows, at], return_inverse=True)
        has = np.zeros((size, len(names)), dtype=np.float32)
        has[rows, column] = 1
        kinds, kind = np.unique(has, axis=0, return_inverse=True)
        kind = kind.ravel()
        order = np.argsort(kind, kind="stable")
        units, blocks, kind = self.units[start : start + size][order], self.block[start : start + size][order], kind[order]
        for at in range(0, size, 512):
            some, own = np.unique(kind[at : at + 512], return_inverse=True)
            free = kinds[some] @ kinds.T == 0
            columns = at + np.flatnonzero(free.any(axis=0)[kind[at:]])
            if not len(columns):
                continue
            near = units[at : at + 512] @ units[columns].T >= threshold
            near &= free[own.ravel()[:, None], kind[columns]]
            if self.cross[start]:
                near &= blocks[at : at + 512, None] != blocks[columns]
            a, b = np.nonzero(near)
            later = a + at < columns[b]
            yield order[a[later] + at] + start, order[columns[b[later]]] + start


def _settled(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches by *label* and the links."""
    tied = np.flatnonzero(label != np.arange(len(label)))
    a, b = np.concatenate([a, tied]), np.concatenate([b, label[tied]])
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if (label == before).all():
            return label


def _compare(threshold: float):
    """Rows (a, b, links): link counts of a where b is null, else an edge of a spanning tree."""

    def emit(members: _Members) -> Iterator[pa.RecordBatch]:
        rows = len(members.key)
        links, label = np.zeros(rows), np.arange(rows)
        for a, b in members.near_pairs(threshold):
            if len(a):
                links += np.bincount(a, members.copies[b], rows) + np.bincount(b, members.copies[a], rows)
                label = _settled(label, a, b)
        some = np.flatnonzero(links)
        if not len(some):
            return
        tied = np.flatnonzero(label != np.arange(len(label)))
        ids = np.concatenate([members.cid[some], members.cid[tied]])
        others = pa.array(np.concatenate([np.zeros(len(some), np.int64), members.cid[label[tied]]]), pa.int64(),
                          mask=np.arange(len(ids)) < len(some))
        counts = np.concatenate([links[some], np.zeros(len(tied))]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), others, pa.array(counts)], ["a", "b", "links"])

    def by_length(table: pa.Table) -> Iterator[pa.RecordBatch]:
        widths = table["key"].to_numpy() // PIVOTS**SHARED
        cuts = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(widths)]
        for start, end in zip(cuts, cuts[1:]):
            yield from emit(_Members(table.slice(start, end - start)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            key, part = held["key"].to_numpy(), held["part"].to_numpy()
            # The last list may go on in the next batch.
            last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from by_length(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from by_length(held)

    return run


def embedding_classes(
    df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    rows = _rows(df, vec_id, embedding)
    classes = stored(_classes(rows), "embedding-classes")
    links, labels = None, None
    if not classes.isEmpty():
        described = stored(_index(classes, _pivots(classes)), "embedding-index")
        entries = described.select("cid", F.explode("keys").alias("key"))
        entries = entries.withColumn("size", F.count("*").over(Window.partitionBy("key"))).filter("size > 1")
        parts = F.ceil(F.col("size") / block).cast("int")
        own = F.pmod("cid", parts).cast("int")
        entries = entries.select("cid", "key", parts.alias("parts"), own.alias("block"))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        entries = entries.select("*", other.alias("other")).select(
            "cid",
            "key",
            "block",
            (F.col("block") != F.col("other")).alias("cross"),
            (F.least("block", "other") * F.col("parts") + F.greatest("block", "other")).alias("part"),
        )
        members = entries.join(described.select("cid", "copies", "vector", "pivots"), "cid")
        members = members.select("key", "part", "block", "cross", "cid", "copies", "vector", "pivots")
        tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        members = members.repartition(tasks, "key", "part").sortWithinPartitions("key", "part", "cid")
        found = stored(members.mapInArrow(_compare(threshold), "a bigint, b bigint, links bigint"), "embedding-links")
        links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
        labels = components(found.filter("b is not null").select("a", "b"))
    return _labelled(rows, classes, links, labels)


def _labelled(rows: DataFrame, classes: DataFrame, links: DataFrame | None, labels: DataFrame | None) -> DataFrame:
    own = F.col("vec_id")
    if labels is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), own.alias("component_id"), own.isNotNull().alias("kept"))
    known = classes.select("cid", "low", "copies").join(labels, F.col("cid") == F.col("node"), "left")
    known = known.withColumn("label", F.coalesce("label", "cid"))
    lowest = known.groupBy("label").agg(F.min("low").alias("component"))
    known = known.join(lowest, "label").join(links, F.col("cid") == F.col("a"), "left")
    known = known.select("cid", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = rows.join(known, "cid", "left")
    component = F.coalesce("component", own)
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == own, F.lit(False)).alias("kept"),
    )


@query("op2_embedding_dedup")
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings."""
    return embedding_classes(read_table(spark, sf_dir, "embeddings"))
