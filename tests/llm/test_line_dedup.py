import random
from itertools import combinations

from gridmark.llm.line_dedup import aligned_blocks, dedup_lines, longest_rise, op5_line_dedup, short_runs, without_shared_lines


def slow_rise(values):
    for n in range(len(values), 0, -1):
        if any(all(a < b for a, b in zip(c, c[1:])) for c in combinations(values, n)):
            return n
    return 0


def slow_dedup(docs):
    """Owners by scan; then alignment, blocks and deletion on lists of lines."""
    docs = sorted(docs)
    owner, out = {}, {}
    whole = {d: t.split("\n") for d, t in docs}
    long = {d: [i for i, x in enumerate(ls) if len(x.split()) >= 5] for d, ls in whole.items()}

    def around(d, rank):
        stops = [*long[d], len(whole[d])]
        return whole[d][long[d][rank] + 1 : stops[rank + 1]], whole[d][: long[d][rank]] if rank == 0 else None

    for d, _ in docs:
        for rank, i in enumerate(long[d]):
            owner.setdefault(whole[d][i], (d, rank))
    for d, _ in docs:
        gone, by = set(), {}
        for rank, i in enumerate(long[d]):
            x = whole[d][i]
            if owner[x][0] != d:
                by.setdefault(owner[x][0], []).append((rank, owner[x][1], len(x.split())))
        for who, one in by.items():
            for block in aligned_blocks(one):
                for rank in block:
                    i, theirs = long[d][rank], owner[whole[d][long[d][rank]]][1]
                    (tail, head), (their_tail, their_head) = around(d, rank), around(who, theirs)
                    gone.add(i)
                    if tail == their_tail:
                        gone |= set(range(i, i + len(tail) + 1))
                    if head is not None and head == their_head:
                        gone |= set(range(i))
        text = "\n".join(x for i, x in enumerate(whole[d]) if i not in gone)
        out[d] = text if text.strip() or not gone else ""
    return out


def test_longest_rise():
    draw = random.Random(3)
    for _ in range(60):
        values = [draw.randint(0, 8) for _ in range(draw.randint(0, 9))]
        run = longest_rise(values)
        assert len(run) == slow_rise(values)
        assert all(values[a] < values[b] and a < b for a, b in zip(run, run[1:]))


def test_blocks_follow_each_other_in_both():
    assert aligned_blocks([(0, 5, 6), (1, 6, 6), (2, 8, 6), (3, 1, 20)]) == [[0, 1], [3]]


def line(draw, n=9):
    return " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(n))


def corpus():
    draw = random.Random(7)
    shared = [line(draw, draw.choice([5, 9, 60])) for _ in range(12)]
    docs = []
    for i in range(60):
        lines = [draw.choice([line(draw), draw.choice(shared), "short", "", draw.choice(shared)]) for _ in range(draw.randint(1, 9))]
        docs.append((i, "\n".join(lines)))
    docs += [(100 + i, docs[i][1]) for i in range(5)]
    return docs


def test_equals_slow_version(spark):
    docs = corpus()
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert got == slow_dedup(docs)
    assert any(t == "" for t in got.values())


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    moved = " ".join(f"q{i}" for i in range(60))
    rows = [
        (1, f"{passage}\n{moved}", 9), (2, f"own line\n{moved}\n-\n{passage}\nend", 9), (2, f"own line\n{moved}\n-\n{passage}\nend", 9),
        (3, None, 9), (4, "", 9), (None, passage, 9), (5, "clean words stand here alone today again now", 9), (6, passage, 9),
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string, spans int")
    got = sorted(dedup_lines(df).collect(), key=str)
    assert len(got) == len(rows)
    texts = {(r.doc_id): r.text for r in got}
    assert texts[1] == rows[0][1] and texts[None] == passage and texts[3] is None and texts[4] == ""
    assert texts[2] == "own line\n-\nend" and texts[6] == "" and texts[5] == rows[6][1]
    kept = without_shared_lines(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 1
    assert dedup_lines(df.limit(0)).count() == 0


def test_query_on_the_small_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r.doc_id: r.text for r in op5_line_dedup(spark, folder).collect()}
    assert got == slow_dedup(docs)


def all_pairs(docs):
    """Lines of common blocks with any earlier document, by every pair of places."""
    gone, seen = {}, []
    for d, t in sorted(docs):
        lines = t.split("\n")
        here = [i for i, x in enumerate(lines) if x.split()]
        deleted = set()
        for earlier in seen:
            for i in range(len(here)):
                for j in range(len(earlier)):
                    n = 0
                    while i + n < len(here) and j + n < len(earlier) and lines[here[i + n]] == earlier[j + n]:
                        n += 1
                    if sum(len(lines[k].split()) for k in here[i : i + n]) >= 8:
                        deleted |= set(here[i : i + n])
        seen.append([lines[i] for i in here])
        gone[d] = deleted
    return gone


def test_short_runs():
    assert short_runs([5, 5, 2, 1]) == [(0, 1), (0, 2), (1, 3)]
    draw = random.Random(2)
    for _ in range(50):
        counts = [draw.randint(1, 9) for _ in range(draw.randint(0, 12))]
        covered = {k for a, b in short_runs(counts) for k in range(a, b + 1)} | {k for k, n in enumerate(counts) if n >= 8}
        assert covered == (set(range(len(counts))) if sum(counts) >= 8 else set())


def test_blocks_of_competing_owners_and_short_lines_equal_all_pairs(spark):
    draw = random.Random(11)
    a, b, c = line(draw, 6), line(draw, 6), line(draw, 7)
    poem = "\n".join(line(draw, 3) for _ in range(4))
    docs = [
        (1, f"{a}\nx"), (2, f"y\n{b}"), (3, f"z\n{a}\n\n{b}\n{c}"), (4, f"own\n{a}\n{b}\n{c}\nend"),
        (5, f"{c}\ntitle\n{b}\n{c}"), (6, f"{b}\n{c}"), (7, f"u\n{poem}\nv"), (8, f"{line(draw)}\n{poem}"),
    ]
    lines = [line(draw, n) for n in (1, 2, 3, 5, 6, 7, 9)]
    docs += [(10 + i, "\n".join(draw.choice([*lines, "", line(draw)]) for _ in range(12))) for i in range(25)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id int, text string"), run_words=1).collect()}
    assert got[4] == "own\nend" and got[6] == "" and got[8].count("\n") == 0
    gone = all_pairs(docs)
    for d, t in docs:
        want = [x for i, x in enumerate(t.split("\n")) if i not in gone[d] and x.split()]
        assert [x for x in got[d].split("\n") if x.split()] == want


def test_query_deletes_blocks_of_competing_owners(spark, tmp_path):
    draw = random.Random(12)
    a, b, c = line(draw, 6), line(draw, 5), line(draw, 7)
    docs = [
        (1, f"{a}\nx"), (2, f"y\n{b}"), (3, f"z\n{a}\n\n{b}\nshort\n{c}"), (4, f"own\n{a}\n{b}\nshort\n{c}\nend"),
        (5, f"{c}\n-\n{a}"), (6, f"{b}\nother\n{c}"),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == dict(docs) | {4: "own\nend", 6: "other"}
    kept = without_shared_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in kept.collect()} == got
