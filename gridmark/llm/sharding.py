"""Sharding: a lookup table filled by preference permutations, and constant-time placement through it.

Shard s prefers the slots ``(offset_s + k * skip_s) mod size`` in order of k; *size* is prime, so that is a permutation
of all slots. Shards take turns, each claiming its next free preferred slot, until the table is full; a shard of weight
w takes w turns in a row. Shares then differ by at most a turn, and adding or removing a shard moves little else.
The table has a fixed size that does not depend on the data, so it is filled once on the driver and broadcast.

Placement is one hash, one modulus and one broadcast join: no shuffle, whatever the keys' skew.

Defined results: rows with equal keys get the same shard; a null key counts as the empty text; an empty table gives no
rows; other columns are kept, and the new columns give way to columns of the same name by added underscores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.llm.catalogue import query
from gridmark.llm.common import fresh, read_table

# At least 100 slots a shard keep shares within one percent of each other.
TABLE_SIZE = 4_099
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
HEX_DIGITS = 13


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX_DIGITS], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> list[int]:
    """The index of the shard that owns each slot."""
    weights = list(weights or [1] * len(shards))
    if not _is_prime(size) or not 0 < sum(weights) <= size or len(weights) != len(shards) or min(weights) < 0:
        raise ValueError("size must be prime and at least the sum of the weights, which must not be negative")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names must differ")
    place = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    owner, free = [-1] * size, size
    while free:
        for shard, turns in enumerate(weights):
            for _ in range(min(turns, free)):
                while owner[place[shard]] >= 0:
                    place[shard] = (place[shard] + skip[shard]) % size
                owner[place[shard]] = shard
                free -= 1
    return owner


def slot_of(key: Column, size: int) -> Column:
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HEX_DIGITS)
    return F.conv(digest, 16, 10).cast("bigint") % size


def place(
    df: DataFrame,
    key: str,
    shards: Sequence[str] = SHARDS,
    size: int = TABLE_SIZE,
    weights: Sequence[int] | None = None,
) -> DataFrame:
    """*df* with ``slot`` and ``shard``."""
    owners = ",".join(shards[o] for o in fill_table(shards, size, weights))
    if any("," in s for s in shards):
        raise ValueError("shard names must not hold commas")
    slot, shard = fresh("slot", df.columns), fresh("shard", df.columns)
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias(slot, shard))
    table = table.withColumn(slot, F.col(f"`{slot}`").cast("bigint"))
    return df.withColumn(slot, slot_of(F.col(f"`{key}`"), size)).join(F.broadcast(table), slot, "left").select(
        *[F.col(f"`{c}`") for c in df.columns], F.col(f"`{slot}`"), F.col(f"`{shard}`")
    )


# The same turns as a recursion: one step claims one slot.
_ORACLE = f"""
with recursive shards as (
  select i, 'shard-' || lpad(i::varchar, 2, '0') as name from range({len(SHARDS)}) t(i)
), params as (
  select list(('0x' || substr(md5('offset:' || name), 1, {HEX_DIGITS}))::bigint % {TABLE_SIZE} order by i) as starts,
         list(('0x' || substr(md5('skip:' || name), 1, {HEX_DIGITS}))::bigint % {TABLE_SIZE - 1} + 1 order by i) as skips
  from shards
), turns(t, owner, slot) as (
  select 0, list_transform(range({TABLE_SIZE}), lambda x: -1), -1::bigint
  union all
  select t + 1, list_transform(owner, lambda o, k: case when k - 1 = pick then t % {len(SHARDS)} else o end), pick
  from (
    select t, owner, list_filter(
      list_transform(range({TABLE_SIZE}), lambda k: (starts[t % {len(SHARDS)} + 1] + k * skips[t % {len(SHARDS)} + 1]) % {TABLE_SIZE}),
      lambda s: owner[s + 1] = -1)[1] as pick
    from turns, params where t < {TABLE_SIZE})
), owners as (
  select slot, 'shard-' || lpad(((t - 1) % {len(SHARDS)})::varchar, 2, '0') as shard from turns where t > 0
)
select doc_id, source, d.slot, shard
from (select doc_id, source,
        ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, {HEX_DIGITS}))::bigint % {TABLE_SIZE} as slot from documents) d
left join owners o on d.slot = o.slot
"""


@query("op1_sharding", _ORACLE)
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return place(read_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
