"""Shard planning, reproducible selection and split checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmark.operators import sampling as sp
from gridmark.operators import sharding as sh
from gridmark.plans.fixtures import read, view, with_views
from gridmark.plans.registry import query
from gridmark.sources import tables as tb

_LIMIT = 200_000


def _token(count: str, digest: str) -> str:
    """SQL of a multiset's token: its size and the sums of eight 32-bit words of the digests."""
    sums = [f"cast(sum(cast('0x' || substr({digest}, {8 * i + 1}, 8) as bigint)) as varchar)" for i in range(8)]
    return f"sha256({' || chr(44) || '.join([count, *sums])})"


# Samples are documents: the text is the payload and the source the sidecar.
_PLAN = f"""
    samples as (select case when doc_id % 5 = 4 then 'val' else 'train' end as split, doc_id as position, n_chars as payload_bytes,
      length(source) * 200 as sidecar_bytes, lang, source from documents),
    sized as (select *, 512 + ((payload_bytes + 511) // 512) * 512 + 512 + ((sidecar_bytes + 511) // 512) * 512 as bytes from samples),
    planned as (select *, cast(floor(coalesce(sum(bytes) over (partition by split order by position
      rows between unbounded preceding and 1 preceding), 0) / {_LIMIT}) as bigint) as shard_id from sized),
    shards as (select split, shard_id, count(*) as samples, cast(sum(bytes) as bigint) as bytes,
      {_token("count(*)", "h")} as digest from (
        select *, sha256(position || '|' || payload_bytes || '|' || lang) as h from planned) group by 1, 2)
"""

# Digests of the whole sorted list of a shard's samples.
_LISTED_PLAN = _PLAN.replace(_token("count(*)", "h"), "sha256(string_agg(h, ',' order by h))")


def _samples(spark, folder):
    split = F.when(F.col("doc_id") % 5 == 4, F.lit("val")).otherwise(F.lit("train"))
    return read(spark, folder, "documents").select(
        split.alias("split"), F.col("doc_id").alias("position"), F.col("n_chars").alias("payload_bytes"),
        (F.length("source") * 200).alias("sidecar_bytes"), "lang", "source",
    )


def _planned(spark, folder):
    return sh.plan_shards(_samples(spark, folder), _LIMIT)


def _shards(spark, folder, listed=False):
    return sh.content_digests(_planned(spark, folder), ["position", "payload_bytes", "lang"], listed)


@query("plan_shards", f"with {_PLAN} select split, position, bytes, shard_id from planned")
def plan_shards(spark, folder):
    return _planned(spark, folder).select("split", "position", "bytes", "shard_id")


@query("shard_digests", f"with {_PLAN} select split, shard_id, samples, bytes, digest from shards")
def shard_digests(spark, folder):
    return _shards(spark, folder)


@query("shard_generation", f"""
    with {_LISTED_PLAN}, l0 as (select split, shard_id as node, sha256(shard_id || '|' || samples || '|' || digest) as digest from shards),
    l1 as (select split, node // 1024 as node, sha256(string_agg(digest, ',' order by node)) as digest from l0 group by 1, 2),
    l2 as (select split, node // 1024 as node, sha256(string_agg(digest, ',' order by node)) as digest from l1 group by 1, 2),
    l3 as (select split, node // 1024 as node, sha256(string_agg(digest, ',' order by node)) as digest from l2 group by 1, 2)
    select split, substr(digest, 1, 8) as generation from l3""")  # fmt: skip
def shard_generation(spark, folder):
    return sh.generation(_shards(spark, folder, listed=True), levels=3)


_CONTENT = ["position", "payload_bytes", "lang"]


@query("updated_shard_digests", f"""
    with {_PLAN}, now as (select * from planned where position % 11 <> 5)
    select split, shard_id, count(*) as samples, cast(sum(bytes) as bigint) as bytes,
      {_token("count(*)", "sha256(position || '|' || payload_bytes || '|' || lang)")} as digest from now group by 1, 2""")  # fmt: skip
def updated_shard_digests(spark, folder):
    """Digests kept up to date: samples that came later are added to the sums, samples that went are taken off."""
    planned = _planned(spark, folder)
    late, gone = F.col("position") % 7 == 3, F.col("position") % 11 == 5
    state = sh.content_sums(planned.filter(~late), _CONTENT)
    state = sh.changed_sums(state, added=sh.content_sums(planned.filter(late), _CONTENT))
    return sh.shard_tokens(sh.changed_sums(state, removed=sh.content_sums(planned.filter(gone), _CONTENT)))


_EPOCHS = f"""
    {_PLAN}, ordered as (select split, epoch, shard_id, samples, row_number() over (partition by split, epoch
      order by md5('0|' || epoch || '|' || shard_id), shard_id) - 1 as position
      from shards cross join (select unnest([0, 1, 2]) as epoch)),
    assigned as (select *, position % 4 as slot from ordered)
"""


@query("epoch_shard_order", f"""
    with {_EPOCHS} select split, epoch::int as epoch, shard_id, position::int as position, slot::int as slot from assigned""")  # fmt: skip
def epoch_shard_order(spark, folder):
    ordered = sh.assign_slots(sh.epoch_order(_shards(spark, folder), 3), 4)
    return ordered.select("split", "epoch", "shard_id", "position", "slot")


@query("shard_skew", f"""
    with {_EPOCHS}, s as (select split, epoch, slot, sum(samples) as n from assigned group by all),
    w as (select split, epoch::int as epoch, cast(sum(n) as bigint) as total, cast(case when count(*) < 4 then 0 else min(n) end as bigint) as worst
          from s group by 1, 2)
    select *, 1 - worst / (total / 4.0::double) as deficit, case when 1 - worst / (total / 4.0::double) > 0.3 then 'fail'
      when 1 - worst / (total / 4.0::double) > 0.05 then 'warn' else 'ok' end as verdict from w""")  # fmt: skip
def shard_skew(spark, folder):
    ordered = sh.assign_slots(sh.epoch_order(_shards(spark, folder), 3), 4)
    return sh.shard_skew(ordered, 4, ["split", "epoch"])


@query("stale_shards", f"""
    with {_LISTED_PLAN} select split, shard_id, digest from shards where shard_id % 3 = 1""")  # fmt: skip
def stale_shards(spark, folder):
    shards = _shards(spark, folder, listed=True)
    return sh.stale_shards(shards, shards.filter(F.col("shard_id") % 3 != 1))


@query("shard_index_problems", f"""
    with {_PLAN} select shard_id, case when shard_id % 4 = 1 then 'unsupported version' when shard_id % 4 = 2
      then 'unknown category policy' else 'index of another split' end as reason from shards
    where shard_id % 4 in (1, 2) or split = 'val'""")  # fmt: skip
def shard_index_problems(spark, folder):
    index = tb.shard_index(_planned(spark, folder), ["position", "payload_bytes", "lang"])
    key = F.col("shard_id") % 4
    broken = index.withColumns(
        {"version": F.when(key == 1, 9).otherwise(F.col("version")), "policy": F.when(key == 2, F.lit("x")).otherwise(F.col("policy"))}
    )
    return tb.index_problems(broken, "train").select("shard_id", "reason")


_DRAWN = "drawn as (select image_id, row_number() over (order by md5('7|' || image_id), image_id) - 1 as r from img)"


@query("image_subset", with_views(f"with {_DRAWN} select image_id from drawn where r < 500", "img"))
def image_subset(spark, folder):
    return sp.subset(view(spark, folder, "img"), 500, seed=7).select("image_id")


@query("tuning_test_split", with_views(
    f"with {_DRAWN} select image_id, case when r < 400 then 'tuning' else 'test' end as part from drawn where r < 900", "img"))
def tuning_test_split(spark, folder):
    tuning, test = sp.tuning_and_test(view(spark, folder, "img"), 400, 500, seed=7)
    parts = [rows.select("image_id", F.lit(name).alias("part")) for rows, name in ((tuning, "tuning"), (test, "test"))]
    return parts[0].unionByName(parts[1])


@query("split_overlap", with_views("select image_id from img where image_id % 6 = 5", "img"))
def split_overlap(spark, folder):
    images = view(spark, folder, "img")
    return sp.overlap(images.filter(F.col("image_id") % 2 == 1), images.filter(F.col("image_id") % 3 == 2))


@query("first_files_by_name", with_views(
    "select image_id, file_name, true as too_few from img order by file_name limit 20", "img"))
def first_files_by_name(spark, folder):
    return sp.first_by_name(view(spark, folder, "img"), 20).select("image_id", "file_name", "too_few")


@query("padded_samples", """
    with n as (select count(*) as n from documents), drawn as (select doc_id, row_number() over (order by md5('3|' || doc_id), doc_id) - 1 as r from documents)
    select doc_id, false as is_repeat from documents union all
    select doc_id, true from drawn, n where r < ((n + 191) // 192) * 192 - n""")  # fmt: skip
def padded_samples(spark, folder):
    return sp.pad_to_multiple(read(spark, folder, "documents").select("doc_id"), "doc_id", 64, 3, seed=3)
