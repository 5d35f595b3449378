import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridmark.llm.best_fit_packing import SEQUENCE, best_fit, op11_best_fit_packing, pack_best_fit, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
FOLDER = "/root/testdata/sf0.001"


def slow_best_fit(sizes, capacity, open_bins):
    """The rule with a plain list of open bins."""
    opened, free, places = [], {}, []
    for size in sizes:
        fitting = [b for b in opened if free[b] >= size]
        if fitting:
            best = min(fitting, key=lambda b: free[b])
        else:
            if len(opened) == open_bins:
                opened.remove(min(opened, key=lambda b: free[b]))
            best = len(free)
            opened.append(best)
            free[best] = capacity
        places.append((free[best], size))
        free[best] -= size
        if not free[best]:
            opened.remove(best)
    return places, sorted(free[b] for b in opened)


@pytest.mark.parametrize("open_bins", [1, 3, 20])
def test_bitset_equals_a_list_of_bins(open_bins):
    draw = random.Random(open_bins)
    sizes = [draw.choice([draw.randint(1, 99), draw.randint(1, 12), 50]) for _ in range(3000)]
    bins, offsets, rest = best_fit(sizes, 100, open_bins)
    # Bins with equal free space are alike, so the free space met by each size tells the rule.
    places, left = slow_best_fit(sizes, 100, open_bins)
    assert [100 - o for o in offsets] == [p[0] for p in places]
    filled = {}
    for b, o, s in zip(bins, offsets, sizes, strict=True):
        assert o == filled.get(b, 0)
        filled[b] = o + s
    assert max(filled.values()) <= 100 and len(rest) <= open_bins
    assert sorted(100 - filled[b] for b in rest) == left


def check(rows, texts, capacity=SEQUENCE):
    """Every id is in exactly one piece, and sequences are gapless and within their bound; the number of sequences."""
    library = Tokenizer.from_file(PATH)
    spans, cut = {}, {}
    for r in rows:
        ids = np.array(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert r.start == r.piece * capacity and r.length == min(capacity, len(ids) - r.start) > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        cut[r.doc_id] = cut.get(r.doc_id, 0) + r.length
        if cut[r.doc_id] == len(ids):
            del cut[r.doc_id]
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not cut and {r.doc_id for r in rows} == set(texts)
    for pieces in spans.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


def test_word_ids_are_the_library_s():
    library = Tokenizer.from_file(PATH)
    texts = [
        "It's  we'll THEY'VE a'b 123 45,6 -- !?\n\ttabs\r\nends ", "café café İstanbul ΣΣ straße", " ́x  y z\u0085w\x0bv\x1cu",
        "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "你好世界 \U0001f600\U0001f600 ﻿", "x" * 300 + " " + "ab1" * 100, "", "\x00 ​‍",
    ]
    draw = random.Random(5)
    letters = "aB'1 \n\t́éΣ你!<|>-  s"
    texts += ["".join(draw.choice(letters) for _ in range(60)) for _ in range(300)]
    for _ in range(2):  # the second time from kept words
        for text, ids in zip(texts, word_ids(PATH).encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("sequence,group_tokens,waste", [(64, 1 << 12, 1.1), (SEQUENCE, 1 << 22, 1.02)])
def test_pieces_and_sequences(spark, sequence, group_tokens, waste):
    draw = random.Random(3)
    texts = {i: " ".join(draw.choice(["one", "Two", "three's", "4"]) for _ in range(draw.choice([0, 3, 30, 200]))) for i in range(600)}
    texts[600] = "hot words " * 5000
    rows = [(i, t, 7, "x") for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, sequence_id string")
    out = pack_best_fit(df, PATH, sequence=sequence, open_bins=8, group_tokens=group_tokens)
    assert out.columns == [*COLUMNS, "ids"]
    got = out.collect()
    sequences = check(got, texts, sequence)
    tokens = sum(r.length for r in got)
    assert sequences <= waste * -(-tokens // sequence) + 1
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_nulls_repeats_empty_and_other_ids(spark):
    rows = [(None, None), (None, "a b"), ("k", "a b"), ("k", "a b"), ("k", " \n "), ("z", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = pack_best_fit(df, PATH, with_ids=False).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("None", 1), ("None", 3), ("k", 1), ("k", 3), ("k", 3), ("z", 1)]
    assert len({r.sequence_id for r in got}) == 1
    at = 0
    for offset, length in sorted((r.offset, r.length) for r in got):
        assert offset == at
        at += length
    empty = pack_best_fit(df.limit(0), PATH, with_ids=False)
    assert empty.collect() == [] and empty.columns == COLUMNS
    with pytest.raises(ValueError):
        pack_best_fit(df, PATH, group_tokens=SEQUENCE)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_query_over_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    out = op11_best_fit_packing(spark, FOLDER)
    assert out.columns == COLUMNS
    assert [k for _, k in out.dtypes] == ["bigint", "int", *["bigint"] * 5]
    got = out.collect()
    assert check(got, texts) <= 1.02 * -(-sum(r.length for r in got) // SEQUENCE) + 1
