import random

import pytest

from gridmark.llm.jaccard_join import near_duplicate_classes, op3_jaccard_join


def slow_classes(rows):
    sets = []
    for _, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in __import__("re").split(r"[ \t-\r]+", lower) if w]
        n = len(words)
        sets.append({tuple(words[i : i + 5]) for i in range(max(n - 4, 1))} if n else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return [(d, len(s), None if d is None else low[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def family(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        at = draw.randrange(len(words))
        draw.choice([lambda: words.__setitem__(at, f"z{draw.random()}"), lambda: words.insert(at, "and"), lambda: words.pop(at)])()
    return " ".join(words)


def corpus(seed, families=12, size=14):
    draw = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [f"w{draw.randint(0, 300)}" for _ in range(draw.choice([3, 6, 30, 90, 200]))]
        rows += [family(draw, base, draw.choice([0, 0, 1, 1, 2, 3, 5]) if len(base) > 10 else draw.choice([0, 1])) for _ in range(size)]
    rows += ["", None, "One two", "one TWO", "É a b c d e", "é a b c d e", "x " * 50]
    draw.shuffle(rows)
    return list(enumerate(rows))


def got(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, cid int")
    return sorted(map(tuple, near_duplicate_classes(df, **options).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == sorted(slow_classes(rows), key=str)


def test_long_lists_in_blocks(spark):
    rows = corpus(3, families=6, size=20)
    assert got(spark, rows, list_block=3) == sorted(slow_classes(rows), key=str)


def test_null_and_repeated_ids_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (7, text), (3, text), (3, text), (3, "something else entirely here now"), (None, None)]
    assert got(spark, rows) == sorted(slow_classes(rows), key=str)
    assert near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_the_small_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, op3_jaccard_join(spark, folder).collect())) == sorted(slow_classes(rows))
