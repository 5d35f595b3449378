import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridmark.llm.packing import encoder, op6_mixture_packing, pack, phases, places
from tests.llm.test_token_counts import texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("window", [1, 7, 64])
@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 1, "c": 2, "d": 3, "e": 1}])
def test_windows_serve_each_queue_its_share(window, weights):
    queues = {"a": 301, "b": 5, "c": 94, "d": 1, "e": 40}
    owner = {}
    for q, first, size, whole, base, path in phases(queues, weights):
        for start in range(0, queues[q], 13):
            length = min(13, queues[q] - start)
            for token, n, position in places(start, length, (first, size, whole, base, path), window):
                for i in range(n):
                    assert position + i not in owner
                    owner[position + i] = (q, token + i)
    # Every token has its own place in one gapless stream, each queue in its order from window to window.
    assert sorted(owner) == list(range(sum(queues.values())))
    assert sorted(owner.values()) == [(q, i) for q in sorted(queues) for i in range(queues[q])]
    assert all([t for _, (x, t) in sorted(owner.items()) if x == q] == list(range(queues[q])) for q in queues)
    if weights is None:
        for end in range(window, len(owner), window):
            given = [owner[i][0] for i in range(end)]
            for q, n in queues.items():
                assert abs(given.count(q) - end * n / len(owner)) <= 3


def test_encoder_equals_the_library():
    library, own = Tokenizer.from_file(PATH), encoder(PATH)
    for text in texts():
        assert own.encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids


def check(pieces, documents):
    """Pieces make up every document, sequences are gapless, full or a power of two."""
    library = Tokenizer.from_file(PATH)
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [0] for d, t in documents}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        own = np.array(ids[p.doc_id][p.start : p.start + p.length], dtype="<u4")
        assert p.ids_crc32 == zlib.crc32(own.tobytes()) and p.doc_tokens == len(ids[p.doc_id])
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[d])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0


def test_query_on_the_small_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(op6_mixture_packing(spark, folder).collect(), docs)


def test_windows_meet_the_proportions_and_weights(spark):
    rows = [(i, f"word{i} " * (i % 40), "abc"[i % 3]) for i in range(300)] + [(900, None, None), (901, "", "a")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    source = {r[0]: r[2] for r in rows}
    for weights in (None, {"a": 1, "b": 3, "c": 1, None: 1}):
        pieces = pack(df, PATH, window=512, weights=weights).collect()
        check(pieces, [r[:2] for r in rows])
        assert all(len(p.ids) == p.length for p in pieces)
        early = [p for p in pieces if p.sequence_id == 0]
        share = sum(p.length for p in early if source[p.doc_id] == "b") / 1024
        total = {s: sum(p.length for p in pieces if source[p.doc_id] == s) for s in set(source.values())}
        want = total["b"] / sum(total.values()) if weights is None else 0.6  # the queue without a name soon runs dry
        assert abs(share - want) < 0.01


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "same", "s"), (1, "same", "s")], "doc_id int, text string, source string")
    pieces = pack(df, PATH).collect()
    assert sum(p.length for p in pieces) == 4 and len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    assert pack(df.limit(0), PATH).collect() == []
