"""Cutting a split into size-bounded shards, and planning who reads which shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark import scale
from gridmark.operators.sampling import draw

# Archive block size, default shard size, share of missing samples that warns and that fails.
BLOCK_BYTES = 512
DEFAULT_SHARD_BYTES = 100 * 1024 * 1024
WARN_DEFICIT = 0.05
FAIL_DEFICIT = 0.30
_FAN_IN = 1024


def footprint(payload_bytes: Column) -> Column:
    """Archive bytes of one member: a header block and the payload rounded up to whole blocks."""
    return F.lit(BLOCK_BYTES) + F.ceil(payload_bytes / BLOCK_BYTES) * BLOCK_BYTES


def plan_shards(samples: DataFrame, max_bytes: int = DEFAULT_SHARD_BYTES) -> DataFrame:
    """Add ``bytes`` and ``shard_id`` to samples (split, position, payload_bytes, sidecar_bytes).

    Shards are cut on the running offset inside the split, so no shard exceeds *max_bytes* plus one sample.
    Splits are scanned in range slices, so their length does not matter.
    """
    if max_bytes <= 0:
        raise ValueError(f"max_bytes must be positive, got {max_bytes}")
    sized = samples.withColumn("bytes", footprint(F.col("payload_bytes")) + footprint(F.col("sidecar_bytes")))
    summed = scale.running_totals(sized, ["split"], ["position"], {"_before": "bytes"}, large=True, inclusive=False)
    return summed.withColumn("shard_id", F.floor(F.col("_before") / max_bytes)).drop("_before")


_SUMS = [f"sum{i}" for i in range(8)]


def _digest_sums(text: Column) -> list[Column]:
    """Sums of the eight 32-bit words of the rows' digests: a hash of the rows as a multiset, whatever their order."""
    digest = F.sha2(text, 256)
    words = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(len(_SUMS))]
    return [F.sum(word).alias(name) for word, name in zip(words, _SUMS, strict=True)]


def content_sums(samples: DataFrame, content: list[str]) -> DataFrame:
    """Per shard: samples, bytes and digest sums. Sums of added samples add to it, those of removed ones are taken off."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content])
    sums = _digest_sums(row)
    return samples.groupBy("split", "shard_id").agg(F.count("*").alias("samples"), F.sum("bytes").alias("bytes"), *sums)


def changed_sums(state: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The sums after samples came and went, from the sums of all three; no sample that stays is read again."""
    names = ["samples", "bytes", *_SUMS]
    parts = state.select("split", "shard_id", *names)
    if added is not None:
        parts = parts.unionByName(added.select("split", "shard_id", *names))
    if removed is not None:
        parts = parts.unionByName(removed.select("split", "shard_id", *[(-F.col(n)).alias(n) for n in names]))
    summed = parts.groupBy("split", "shard_id").agg(*[F.sum(n).alias(n) for n in names])
    return summed.filter(F.col("samples") > 0)


def _token(*names: str) -> Column:
    return F.sha2(F.concat_ws(",", *[F.col(n).cast("string") for n in names]), 256)


def shard_tokens(sums: DataFrame) -> DataFrame:
    return sums.select("split", "shard_id", "samples", "bytes", _token("samples", *_SUMS).alias("digest"))


def content_digests(samples: DataFrame, content: list[str], listed: bool = False) -> DataFrame:
    """One digest per shard from the digests of its samples, in any order.

    *listed* digests are of the whole sorted list of the samples' digests instead of their sums; a shard is size-bounded, so
    its list is too.
    """
    if not listed:
        return shard_tokens(content_sums(samples, content))
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]), 256)
    return samples.groupBy("split", "shard_id").agg(
        F.count("*").alias("samples"),
        F.sum("bytes").alias("bytes"),
        F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(row))), 256).alias("digest"),
    )


def generation(shards: DataFrame, levels: int | None = None) -> DataFrame:
    """Content token of a split from its shards' numbers, sizes and digests: of their sums, or of a tree of that many *levels*.

    A node of the tree combines up to 1,024 children in order.
    """
    row = F.concat_ws("|", F.col("shard_id").cast("string"), F.col("samples").cast("string"), "digest")
    if levels is None:
        sums = shards.groupBy("split").agg(F.count("*").alias("shards"), *_digest_sums(row))
        return sums.select("split", F.substring(_token("shards", *_SUMS), 1, 8).alias("generation"))
    level = shards.select("split", F.col("shard_id").alias("node"), F.sha2(row, 256).alias("digest"))
    children = F.sort_array(F.collect_list(F.struct("node", "digest")))
    for _ in range(levels):
        parents = level.groupBy("split", F.floor(F.col("node") / _FAN_IN).alias("_parent"))
        nodes = parents.agg(F.sha2(F.concat_ws(",", children["digest"]), 256).alias("digest"))
        level = nodes.withColumnRenamed("_parent", "node")
    return level.select("split", F.substring("digest", 1, 8).alias("generation"))


def epoch_order(shards: DataFrame, epochs: int, seed: int = 0) -> DataFrame:
    """Shard order of every epoch: ``position`` in a seeded shuffle. Rows are shards, not samples."""
    rows = shards.select("split", "shard_id", "samples", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    order = Window.partitionBy("split", "epoch").orderBy(draw(seed, "epoch", "shard_id"), "shard_id")
    return rows.withColumn("position", F.row_number().over(order) - 1)


def assign_slots(ordered: DataFrame, slots: int) -> DataFrame:
    """Reader slot of each shard: its position modulo the slots. Each epoch is a partition of the shards."""
    return ordered.withColumn("slot", F.col("position") % slots)


def shard_skew(assigned: DataFrame, slots: int, keys: list[str]) -> DataFrame:
    """Worst slot's samples against the average, and whether that warns or fails."""
    per_slot = assigned.groupBy(*keys, "slot").agg(F.sum("samples").alias("samples"))
    rows = per_slot.groupBy(*keys).agg(
        F.sum("samples").alias("total"),
        # A slot without any shard is served nothing.
        F.when(F.count("*") < slots, F.lit(0).cast("long")).otherwise(F.min("samples")).alias("worst"),
    )
    average = F.col("total") / F.lit(float(slots))
    deficit = F.when(average > 0, F.lit(1.0) - F.col("worst") / average).otherwise(F.lit(0.0))
    verdict = (
        F.when(F.col("deficit") > FAIL_DEFICIT, F.lit("fail"))
        .when(F.col("deficit") > WARN_DEFICIT, F.lit("warn"))
        .otherwise(F.lit("ok"))
    )
    return rows.withColumn("deficit", deficit).withColumn("verdict", verdict)


def stale_shards(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Shards only the previous index lists."""
    keys = ["split", "shard_id", "digest"]
    return previous.select(*keys).exceptAll(current.select(*keys)).distinct()
