import hashlib
import random

from pyspark.sql import functions as F

from gridmark.operators import sharding as sh

SAMPLES = "split string, shard_id long, position long, bytes long, text string"


def samples(spark, rows):
    return spark.createDataFrame(rows, SAMPLES)


def tokens(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_tokens_ignore_order_and_layout_but_not_content(spark):
    draw = random.Random(1)
    rows = [("train", i % 4, i, 10 + i, draw.choice(["a", "b", None])) for i in range(200)]
    first = tokens(sh.content_digests(samples(spark, rows), ["position", "text"]))
    draw.shuffle(rows)
    assert tokens(sh.content_digests(samples(spark, rows).repartition(7), ["position", "text"])) == first
    changed = [("train", 0, 0, 10, "c") if r[2] == 0 else r for r in rows]
    assert sum(a != b for a, b in zip(first, tokens(sh.content_digests(samples(spark, changed), ["position", "text"])), strict=True)) == 1
    # A row twice is not the row once, and two rows that trade places between shards are seen.
    twice = tokens(sh.content_digests(samples(spark, [*rows, rows[0]]), ["position", "text"]))
    assert twice != first
    moved = [(s, 1 - k if p in (0, 1) else k, p, b, t) for s, k, p, b, t in rows]
    assert tokens(sh.content_digests(samples(spark, moved), ["position", "text"])) != first


def test_sums_follow_changes_without_the_old_rows(spark):
    draw = random.Random(2)
    pool = [(draw.choice(["train", "val"]), draw.randrange(5), i, draw.randrange(99), draw.choice("xyz")) for i in range(300)]
    held, state = list(pool[:200]), None
    state = sh.content_sums(samples(spark, held), ["position", "text"])
    for step in range(3):
        come, go = pool[200 + 30 * step : 230 + 30 * step], draw.sample(held, 25)
        state = sh.changed_sums(state, *(sh.content_sums(samples(spark, part), ["position", "text"]) for part in (come, go)))
        held = [r for r in held if r not in go] + come
    want = sh.content_digests(samples(spark, held), ["position", "text"])
    assert tokens(sh.shard_tokens(state)) == tokens(want)
    assert tokens(sh.generation(sh.shard_tokens(state))) == tokens(sh.generation(want))
    gone = sh.changed_sums(state, removed=state.filter("shard_id = 2"))
    assert gone.filter("shard_id = 2").isEmpty() and gone.count() == state.filter("shard_id <> 2").count()


def test_no_list_is_collected(spark):
    frame = sh.generation(sh.content_digests(samples(spark, [("a", 0, 0, 1, "x")]).withColumn("text", F.upper("text")), ["text"]))
    assert "collect" not in frame._jdf.queryExecution().toString().lower()


def test_listed_digests_cover_every_sample_and_shard_in_order(spark):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    rows = [("train", i // 3, i, 10, "t") for i in range(3 * 1500)]
    listed = sh.content_digests(samples(spark, rows), ["position", "text"], listed=True)
    want = {k: sha(",".join(sorted(sha(f"{i}|t") for i in range(3 * k, 3 * k + 3)))) for k in range(1500)}
    assert {r.shard_id: r.digest for r in listed.collect()} == want
    leaves = [sha(f"{k}|3|{want[k]}") for k in range(1500)]
    nodes = [sha(",".join(leaves[:1024])), sha(",".join(leaves[1024:]))]
    assert [tuple(r) for r in sh.generation(listed, levels=3).collect()] == [("train", sha(sha(",".join(nodes)))[:8])]
