from collections import Counter

import pytest

from gridmark.llm.sharding import _number, fill_table, place


def slow_table(shards, size):
    """Turn by turn over written-out preference lists."""
    wishes = []
    for s in shards:
        start, step = _number(f"offset:{s}") % size, _number(f"skip:{s}") % (size - 1) + 1
        wishes.append([(start + k * step) % size for k in range(size)])
    owner = {}
    for turn in range(size):
        who = turn % len(shards)
        owner[next(w for w in wishes[who] if w not in owner)] = who
    return [owner[i] for i in range(size)]


def test_table_equals_written_out_turns():
    shards = ["a", "b", "c", "d", "e"]
    for size in (7, 101, 499):
        table = fill_table(shards, size)
        assert table == slow_table(shards, size)
        shares = Counter(table).values()
        assert max(shares) - min(shares) <= 1


def test_removing_a_shard_moves_little():
    names = [f"s{i}" for i in range(10)]
    before, after = fill_table(names, 1009), fill_table(names[:-1], 1009)
    moved = sum(b != a for b, a in zip(before, after, strict=True) if b != 9)
    assert moved < 0.25 * 1009


def test_weights_and_bad_parameters():
    shares = Counter(fill_table(["a", "b"], 101, [3, 1]))
    assert abs(shares[0] - 3 * shares[1]) <= 3
    for bad in ((["a"], 100, None), (["a", "a"], 7, None), (["a", "b"], 2, [2, 2])):
        with pytest.raises(ValueError):
            fill_table(*bad)


def test_place_keeps_rows_and_columns(spark):
    rows = [(1, "x"), (1, "x"), (None, None), (2, "y")]
    df = spark.createDataFrame(rows, "doc_id int, shard string")
    placed = place(df, "doc_id", ["a", "b", "c"], 101)
    assert placed.columns == ["doc_id", "shard", "slot", "shard_"]
    got = placed.collect()
    assert len(got) == 4 and all(r.shard_ in "abc" for r in got)
    assert len({r.shard_ for r in got if r.doc_id == 1}) == 1
    assert place(df.limit(0), "doc_id", ["a"], 7).count() == 0
