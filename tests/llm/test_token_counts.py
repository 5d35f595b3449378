import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridmark.llm.token_counts import PrefixTable, count_tokens, counter, truncation_points

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", "don't we'll they're", "x  y", "a\n\n b", "a\n\n\nb ", "tab\t\tq", "123 4567", "!!'s '", "é ñandú ß",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|", "aaaaaaaaaaaaaaaaaaaaaaaa", "word " * 20, "　  x", "日本語 текст", "we've  <|endoftext|>\n",
]


@pytest.fixture(scope="module")
def library():
    whole = Tokenizer.from_file(PATH)
    return lambda text: len(whole.encode(text, add_special_tokens=False).ids)


def texts():
    draw = random.Random(5)
    parts = ["the", " and", "ing", "'", "ll", " ", "  ", "\n", "7", "$", "é", "zqx", "-", "<|endoftext|>", "\t"]
    return ODD + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 12))) for _ in range(150)]


def test_counts_equal_the_library(library):
    own = counter(PATH)
    for text in texts():
        assert own.count(text) == library(text), repr(text)


def test_every_prefix_equals_encoding_it(library):
    own = counter(PATH)
    for text in texts():
        assert own.prefix_counts(text) == [library(text[:n]) for n in range(len(text) + 1)], repr(text)


def test_reach_is_the_longest_prefix_within_budget():
    own = counter(PATH)
    for text in texts()[:60]:
        counts = own.prefix_counts(text)
        table = PrefixTable(counts)
        for budget in range(6):
            want = max(n for n, c in enumerate(counts) if c <= budget)
            assert table.reach(budget) == own.reach(text, budget) == want
        assert table.tokens(3) == counts[min(3, len(text))]


def test_tables(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([None, *ODD, ODD[3]])]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_tokens string")
    got = {r.doc_id: r for r in count_tokens(df, PATH, limit=4).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        n = library(text or "")
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 4)
    cut = {r.doc_id: r.characters for r in truncation_points(df, PATH, [0, 2]).collect()}
    assert cut[0] == [0, 0] and cut[4] == [0, len("don't")]
    assert count_tokens(df.limit(0), PATH).count() == 0
