import duckdb

import corpus_pipeline
from gridmark.llm import quality_rules
from tests.llm.test_jaccard_join import slow_classes
from tests.llm.test_line_dedup import slow_dedup
from tests.llm.test_mixing import slow_targets
from tests.llm.test_packing import check

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, results = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        results.append(docs.collect())
        assert docs.columns == columns or name == "mixture_packing"
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    good, lined, single, mixed, packed = results

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"select doc_id from ({quality_rules._ORACLE}) where kept").fetchall()}
    assert sorted(good) == sorted(r for r in raw if r.doc_id in kept) and 0.6 * len(raw) < len(good)

    want = slow_dedup([(r.doc_id, r.text) for r in good])
    assert {r.doc_id: r.text for r in lined} == {d: t for d, t in want.items() if t}
    assert all(r.n_chars == len(r.text) for r in lined)

    classes = slow_classes([(r.doc_id, r.text) for r in lined])
    assert sorted(single) == sorted(r for r in lined if r.doc_id in {c[2] for c in classes})

    size = lambda r: len(r.text.split())
    sizes = {}
    for r in single:
        sizes[r.source] = sizes.get(r.source, 0) + size(r)
    targets = slow_targets(sizes, (3, 1, 2), 1.5 * sum(sizes.values()))
    largest = max(map(size, single))
    for source, target in targets.items():
        assert abs(sum(size(r) for r in mixed if r.source == source) - target) <= largest
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in single}

    times = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    once = [p for p in packed if times[p.doc_id] == 1]
    tokens = {}
    for p in packed:
        assert len(p.ids) == p.length
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    assert all(tokens[p.doc_id] == times[p.doc_id] * p.doc_tokens for p in packed) and tokens.keys() == times.keys()
    assert once
    places = sorted((p.sequence_id, p.offset, p.length) for p in packed)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and out.columns[-1] == "ids"
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "jaccard_join"
    assert callable(check)


def test_one_row_of_each_class_stays(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcd")
    near = c + " more"
    rows = [(5, a), (5, b), (3, a), (7, b), (7, b), (9, c), (9, c), (8, near), (None, d), (None, d), (None, a), (1, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    single = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert single.columns == docs.columns
    got = [(r.doc_id, r.text) for r in single.collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (8, near), (None, d), (1, None), (2, "")], key=str)
