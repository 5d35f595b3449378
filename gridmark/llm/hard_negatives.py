"""Hard-negative mining with exact integer scores from Kronecker-packed products.

Components become whole numbers. One wide integer holds one component of many candidates, each biased to be non-negative
and in a field of its own, wide enough for the largest possible sum. Multiplying it by an anchor's component multiplies
all fields at once; the sum of these products over the components has every candidate's inner product in its field, off
by the bias times the anchor's sum. Half a field is added before unpacking, so negative sums borrow nothing from their
neighbours.

Anchors are a stated query set against all rows, in blocks: candidates and anchors are dealt by hash into blocks of
BLOCK_VALUES components, and a task scores one block of anchors against one block of candidates. It returns no pairs but
each anchor's best of that block: first the best rows of the same label, whose best over all blocks are the anchor's
positives, then, with the positives' scores known, the best rows of other labels inside each positive's band. Blocks
follow from the number of rows; a label that holds most rows changes nothing.

Defined results: rows with a null label, a null vector, or null or non-finite components take no part, nor do rows whose
whole-number vector is longer than 2^28, for scores of such might not fit a long; vectors meet those of their own length
(empty ones too, with scores 0); a row without id is a candidate, last among ties, but no anchor; rows that repeat an id
are rows of their own; an anchor without positives, or a positive without negatives, returns nothing; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmark.llm.catalogue import query
from gridmark.llm.common import read_table, stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A negative's score lies within these hundredths of its positive's.
LOW, HIGH = 80, 100
# Components of a block, and candidates that share one wide integer.
BLOCK_VALUES = 1 << 20
FIELDS = 1_024
# Squared length of a usable vector: a hundred times a score still fits a long.
LONGEST = float(1 << 56)


class PackedBlock:
    """Candidates of one length, packed for exact inner products with anchors whose components stay within *reach*."""

    def __init__(self, vectors: np.ndarray, reach: int):
        self.rows, self.dims = vectors.shape
        low = int(vectors.min(initial=0))
        high = int(vectors.max(initial=0)) - low
        self.bias = -low
        # A field holds sums of either sign, so it has one bit more than the largest sum.
        bits = (self.dims * high * max(reach, 1)).bit_length() + 1
        self.width = 4 if bits <= 32 else 8 * -(-bits // 64)
        self.half = sum(1 << (8 * self.width * (k + 1) - 1) for k in range(min(FIELDS, self.rows)))
        biased = (vectors - low).astype("<u8")
        self.packs = []
        for at in range(0, self.rows, FIELDS):
            part = biased[at : at + FIELDS]
            fields = np.zeros((self.dims, len(part), self.width), np.uint8)
            lower = np.ascontiguousarray(part.T).view(np.uint8).reshape(self.dims, len(part), 8)
            fields[:, :, : min(8, self.width)] = lower[:, :, : min(8, self.width)]
            self.packs.append((len(part), [int.from_bytes(f.tobytes(), "little") for f in fields]))

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The inner products of all candidates with *anchor*."""
        width, found = self.width, []
        for rows, integers in self.packs:
            total = 0
            for component, integer in zip(anchor, integers, strict=True):
                if component:
                    total += component * integer
            half = self.half & ((1 << (8 * width * rows)) - 1)
            raw = (total + half).to_bytes(width * rows, "little")
            if width == 4:
                found.append(np.frombuffer(raw, "<u4").astype(np.int64) - (1 << 31))
            elif width == 8:
                # Wrapping 64-bit sums are exact, because scores fit.
                found.append((np.frombuffer(raw, "<u8") + np.uint64(1 << 63)).view(np.int64))
            else:
                # The half of a wide field lies above its low 64 bits.
                found.append(np.frombuffer(raw, "<u8")[:: width // 8].view(np.int64))
        joined = np.concatenate(found) if found else np.zeros(0, np.int64)
        shift = self.bias * sum(anchor)
        return joined - np.uint64(shift % (1 << 64)).astype(np.int64)


def _rows(df: DataFrame, vec_id: str, embedding: str, label: str, anchor: Column, scale: int) -> DataFrame:
    """``row, vec_id, label, dims, vector, anchor`` of the rows that take part; written, so that row numbers stay."""
    vector = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x))
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.lit(float(scale)) * F.abs(x) + 1, F.lit(2.0)))
    named = df.select(
        F.col(f"`{vec_id}`").alias("vec_id"),
        F.col(f"`{label}`").alias("label"),
        F.when(finite & (squares < LONGEST), scaled).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).filter("label IS NOT NULL AND vector IS NOT NULL")
    sized = named.withColumn("dims", F.size("vector").cast("bigint"))
    return stored(sized.withColumn("row", F.monotonically_increasing_id()), "hard-negative-rows")


def _matrix(table: pa.Table) -> np.ndarray:
    values = table["vector"].combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(table.num_rows, -1)


def _codes(table: pa.Table, known: dict) -> np.ndarray:
    """Labels as small numbers; *known* is extended."""
    encoded = pc.dictionary_encode(table["label"].combine_chunks())
    numbers = [known.setdefault(v, len(known)) for v in encoded.dictionary.to_pylist()]
    return np.array(numbers, np.int64)[encoded.indices.to_numpy(zero_copy_only=False)]


class Cell:
    """One block of candidates and the anchors that meet it, one vector length at a time."""

    def __init__(self, candidates: pa.Table, anchors: pa.Table):
        self.labels: dict = {}
        self.candidates, self.anchors = candidates, anchors

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Table, np.ndarray]]:
        """Of each anchor: its place, all scores, whether labels are equal, the candidates, and their order among ties."""
        dims = self.anchors["dims"].to_numpy()
        for length in np.unique(dims):
            candidates = self.candidates.filter(pc.equal(self.candidates["dims"], int(length)))
            if not candidates.num_rows:
                continue
            places = np.flatnonzero(dims == length)
            anchors = self.anchors.take(pa.array(places))
            # Nulls sort last, so a lower place here is a smaller id.
            order = np.empty(candidates.num_rows, np.int64)
            order[pc.sort_indices(candidates["vec_id"]).to_numpy()] = np.arange(candidates.num_rows)
            vectors = _matrix(anchors)
            block = PackedBlock(_matrix(candidates), int(np.abs(vectors).max(initial=0)))
            own, labels = _codes(anchors, self.labels), _codes(candidates, self.labels)
            for place, vector, label in zip(places, vectors.tolist(), own, strict=True):
                yield int(place), block.scores(vector), labels == label, candidates, order


def _first(chosen: np.ndarray, scores: np.ndarray, order: np.ndarray, count: int) -> np.ndarray:
    """The first *count* of the chosen places by falling score, then smaller id."""
    if len(chosen) > count:
        least = np.partition(scores[chosen], len(chosen) - count)[len(chosen) - count]
        chosen = chosen[scores[chosen] >= least]
    return chosen[np.lexsort((order[chosen], -scores[chosen]))][:count]


def _copies(count: int) -> Column:
    """A copy of the row for each of *count* blocks."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))


def _table(anchors: pa.Table, found: list[tuple[int, pa.Array, np.ndarray, np.ndarray]], names: list[str]) -> pa.Table:
    """Rows (anchor's row, the band's positive score, candidate's id, candidate's score)."""
    if not found:
        kind = anchors["vec_id"].type
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), kind, pa.int64())], names)
    rows = anchors["row"].to_numpy()
    owner = np.repeat(rows[[f[0] for f in found]], [len(f[3]) for f in found])
    bands = np.concatenate([f[2] for f in found])
    return pa.table([owner, bands, pa.concat_arrays([f[1] for f in found]), np.concatenate([f[3] for f in found])], names)


def mine_hard_negatives(
    df: DataFrame,
    anchor: Column,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where *anchor* holds."""
    kind = df.schema[vec_id].dataType.simpleString()
    rows = _rows(df, vec_id, embedding, label, anchor & F.col(f"`{vec_id}`").isNotNull(), scale)
    sizes = rows.agg(F.sum("dims"), F.sum(F.when(F.col("anchor"), F.col("dims")))).first()
    blocks, parts = (max(1, -(-(n or 0) // block_values)) for n in sizes)
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts))
    candidates = rows.select(block.alias("block"), _copies(parts).alias("part"), "row", "vec_id", "label", "dims", "vector")
    # Names of its own, so that the two sides of the same table do not mix.
    candidates = candidates.toDF(*candidates.columns)
    anchors = rows.filter("anchor").withColumn("part", part)

    def meet(left: DataFrame, decide, schema: str) -> DataFrame:
        """*decide* for each block of candidates and each part of the anchors."""
        dealt = left.select("*", _copies(blocks).alias("block")).groupBy("block", "part")
        return dealt.cogroup(candidates.groupBy("block", "part")).applyInArrow(decide, schema)

    names = ["row", "band", "other", "score"]
    schema = f"row bigint, band bigint, other {kind}, score bigint"

    def same_label(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        found, own = [], anchors["row"].to_numpy()
        for place, scores, same, rows, order in Cell(candidates, anchors):
            chosen = np.flatnonzero(same & (rows["row"].to_numpy() != own[place]))
            best = _first(chosen, scores, order, positives)
            ids = rows["vec_id"].combine_chunks().take(pa.array(best))
            found.append((place, ids, np.zeros(len(best), np.int64), scores[best]))
        return _table(anchors, found, names)

    def other_label(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        found, bands = [], anchors["bands"].to_pylist()
        for place, scores, same, rows, order in Cell(candidates, anchors):
            other = np.flatnonzero(~same)
            hundreds = 100 * scores[other]
            ids = rows["vec_id"].combine_chunks()
            for band in set(bands[place]):
                inside = other[(hundreds >= low * band) & (hundreds <= high * band)]
                best = _first(inside, scores, order, negatives)
                found.append((place, ids.take(pa.array(best)), np.full(len(best), band), scores[best]))
        return _table(anchors, found, names)

    def best_of_all(found: DataFrame, keys: list[str], count: int, rank: str) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("other").asc_nulls_last())
        return found.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= count)

    slim = anchors.select("row", "part", "vec_id", "label", "dims", "vector")
    near = stored(best_of_all(meet(slim, same_label, schema), ["row"], positives, "place"), "hard-negative-positives")
    bands = near.groupBy("row").agg(F.collect_set("score").alias("bands"))
    hard = meet(slim.join(bands, "row"), other_label, schema)
    hard = best_of_all(hard, ["row", "band"], negatives, "rank")
    pairs = near.select("row", F.col("score").alias("band"), "place", F.col("other").alias("positive_id"))
    named = slim.select("row", F.col("vec_id").alias("anchor_id"))
    return (
        hard.join(pairs, ["row", "band"])
        .join(named, "row")
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("other").alias("negative_id"),
            F.col("band").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )


OP12_SQL = """
WITH usable AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
whole AS MATERIALIZED (
  SELECT vec_id, label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM usable),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other, score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
bands AS (
  SELECT p.anchor_id, p.other AS positive_id, p.score AS positive_score, n.other AS negative_id, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank
  FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM bands WHERE rank <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with the labels of every seventh one shifted."""
    df = read_table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(df.withColumn("label", shifted), F.col("vec_id") % 100 == 0)
