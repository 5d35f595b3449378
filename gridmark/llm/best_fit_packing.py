"""Best-fit packing of documents into sequences with a bounded number of open bins.

Documents are encoded, closed with an end token and, where longer than a sequence, cut into whole sequences and a rest.
Whole sequences need no packing. Every other piece meets, in its turn, the open bins of its group: a bitset has one bit
for each amount of free space that some open bin has, so the lowest set bit from the piece's size on names the best fit.
Where nothing fits a new bin is opened; beyond OPEN_BINS the fullest open bin closes first.

Pieces are dealt to groups of about GROUP_TOKENS tokens by a hash of their row, so no source, document or length makes a
large group, and the number of groups follows from the tokens alone. The bins still open at a group's end are pieces of
the next level, packed by the same rule in fewer groups until one is left; then borders between groups waste nothing
but the bounded bins of the last one. Only row numbers and sizes are shuffled to be packed.

Encoding cuts a text at blanks, tabs and line ends, which no token crosses, and keeps the ids of recent words. Words not
yet seen are encoded many at a time: plain ones with ``tiktoken`` and the same merges in the same order, others by
``tokenizers`` itself, so ids are the library's for the whole text; the tests compare both.

Defined results: a null or empty text has the end token alone; rows that repeat an id are documents of their own, also
without id; an empty table gives no rows; very long texts are cut like others; further columns are ignored. Texts of
blanks only have the end token alone.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.llm.catalogue import query
from gridmark.llm.common import read_table, stored
from gridmark.llm.token_counts import _byte_letters

SEQUENCE = 4_096
END_ID = 1
# Bins that may be open at once in a group, and tokens of a group.
OPEN_BINS = 128
GROUP_TOKENS = 1 << 22
# Words whose ids a task keeps, and the longest word kept.
KEPT_WORDS = 1 << 17
LONG_WORD = 64
# Documents encoded at a time.
CHUNK = 64


class WordIds:
    """Ids of texts as bytes of little-endian 32-bit numbers, word by word; the ids of recent words are kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.plain = PlainWords(path)
        self.known = {"": b""}

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        cut = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known = {"": b""}
        new = set().union(*cut) - self.known.keys()
        plain = [w for w in new if self.plain.takes(w)]
        self.known.update(zip(plain, self.plain.encode(plain), strict=True))
        other = list(new.difference(plain))
        encoded = self.library.encode_batch_fast(other, add_special_tokens=False) if other else []
        self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(other, encoded, strict=True))
        found = [b"".join(map(self.known.__getitem__, words)) for words in cut]
        for word in new:
            if len(word) > LONG_WORD:
                del self.known[word]
        return found


class PlainWords:
    """The same ids for words of plain letters, many words in one call of a faster encoder.

    The vocabulary marks the end of a word. Here a character that no plain word has stands for that mark, and its bytes
    join what is before them first of all, as if the vocabulary's single letters came with and without the mark.
    """

    MARK = "\ue000"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        letters, mark = _byte_letters(), self.MARK.encode()
        specials = {t["content"] for t in whole["added_tokens"]}
        ends, ranks, self.ids = "</w>", {}, []

        def add(token: bytes, number: int) -> None:
            if token not in ranks:
                ranks[token] = len(ranks)
                self.ids.append(number)

        vocabulary = {
            bytes(letters[c] for c in t.removesuffix(ends)) + (mark if t.endswith(ends) else b""): i
            for t, i in sorted(whole["model"]["vocab"].items(), key=lambda e: e[1])
            if t not in specials
        }
        for byte in range(256):
            add(bytes([byte]), vocabulary[bytes([byte])])
        for token in (mark[:2], mark):
            add(token, -1)
        for byte in range(256):
            add(bytes([byte]) + mark, vocabulary[bytes([byte]) + mark])
        for token, number in vocabulary.items():
            add(token, number)
        # Plain characters are alike in every version of the letter tables: nothing to compose, one lower case each.
        self.plain = re.compile(r"[\x21-\x7e\u00a1-\u012f\u0131-\u017f]+").fullmatch
        letter, number = r"a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\n{letter}{number}]+")
        self.encoder = tiktoken.Encoding(
            "own", pat_str=f"[^{self.MARK}\n]+{self.MARK}|\n", mergeable_ranks=ranks, special_tokens={}
        )
        self.ids = np.array(self.ids, np.int64)
        self.line = ranks[b"\n"]

    def takes(self, word: str) -> bool:
        own = word.isprintable() if word.isascii() else self.plain(word)
        # The vocabulary's special strings begin like this.
        return bool(own) and len(word) <= LONG_WORD and "<|" not in word

    def encode(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        marked = self.pieces.sub(r"\g<0>" + self.MARK, "\n".join(words).lower())
        ranks = self.encoder.encode_to_numpy(marked)
        data = self.ids[ranks].astype("<u4").tobytes()
        ends = np.append(np.flatnonzero(ranks == self.line), len(ranks)) * 4
        starts = np.concatenate([[0], ends[:-1] + 4])
        return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def best_fit(sizes: Iterable[int], capacity: int, open_bins: int) -> tuple[list[int], list[int], set[int]]:
    """Bin and offset of each size in turn, and the bins still open at the end."""
    bins, offsets = [], []
    # Bit f of the set says that some open bin has f free places; full bins are closed.
    spaces, by_space, opened, n_open = 0, {}, 0, 0
    for size in sizes:
        fitting = spaces >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
        else:
            if n_open == open_bins:
                fullest = (spaces & -spaces).bit_length() - 1
                by_space[fullest].pop()
                if not by_space[fullest]:
                    spaces ^= 1 << fullest
                n_open -= 1
            free = capacity
            by_space.setdefault(free, []).append(opened)
            spaces |= 1 << free
            opened, n_open = opened + 1, n_open + 1
        number = by_space[free].pop()
        if not by_space[free]:
            spaces ^= 1 << free
        left = free - size
        if left:
            by_space.setdefault(left, []).append(number)
            spaces |= 1 << left
        else:
            n_open -= 1
        bins.append(number)
        offsets.append(capacity - free)
    return bins, offsets, {b for numbers in by_space.values() for b in numbers}


_PLACED = "item bigint, size bigint, sequence_id bigint, offset bigint, open boolean"


def _placed(items: DataFrame, capacity: int, open_bins: int, group_tokens: int, level: int = 0) -> DataFrame:
    """``item, sequence_id, offset`` of all ``item, size``; sizes are below the capacity."""
    total = items.agg(F.sum("size")).first()[0] or 0
    groups = -(-total // group_tokens) or 1

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # The arrival order of a group is that of its rows' numbers, whatever the shuffle's.
        table = table.sort_by("item")
        bins, offsets, rest = best_fit(table["size"].to_pylist(), capacity, open_bins)
        first = (level << 56) + (key[0].as_py() << 28)
        columns = [table["item"], table["size"], pa.array([first + b for b in bins], pa.int64())]
        columns += [pa.array(offsets, pa.int64()), pa.array([b in rest for b in bins], pa.bool_())]
        return pa.table(columns, ["item", "size", "sequence_id", "offset", "open"])

    group = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups))
    dealt = items.select(group.alias("group"), "item", "size")
    placed = stored(dealt.groupBy("group").applyInArrow(fit, _PLACED), "best-fit-bins")
    if groups == 1:
        return placed.select("item", "sequence_id", "offset")
    # A group has at least group_tokens / capacity bins' worth of tokens and leaves open_bins of them, so levels shrink.
    rest = placed.filter("open").groupBy("sequence_id").agg(F.sum("size").alias("size"))
    rest = stored(rest.withColumnRenamed("sequence_id", "item"), "best-fit-open")
    merged = _placed(rest, capacity, open_bins, group_tokens, level + 1).toDF("bin", "merged", "shift")
    moved = placed.join(merged, F.col("open") & (F.col("sequence_id") == F.col("bin")), "left")
    return moved.select(
        "item",
        F.coalesce("merged", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def _pieces(df: DataFrame, path: str, doc_id: str, text: str, end_id: int, sequence: int, with_ids: bool) -> DataFrame:
    """``row, doc_id, piece, start, length, ids_crc32`` and, if wanted, the ids; written, so that row numbers stay."""
    kind = df.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = word_ids(path).encode, np.array([end_id], "<u4").tobytes(), 4 * sequence
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                owners, rows, kept = [], [], []
                for row, ids in enumerate(encode(part.column(1).to_pylist())):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), step)):
                        own = ids[start : start + step]
                        owners.append(row)
                        rows.append((piece, start // 4, len(own) // 4, zlib.crc32(own)))
                        kept.append(own if with_ids else b"")
                table = np.array(rows, np.int64).reshape(-1, 4)
                columns = [part.column(0).take(pa.array(owners, pa.int64())), pa.array(table[:, 0].astype(np.int32))]
                columns += [pa.array(table[:, i]) for i in (1, 2, 3)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(table[:, 2])]).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(kept), "<u4").astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), values))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    rows = df.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, schema)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "best-fit-pieces")


def pack_best_fit(
    df: DataFrame,
    path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    sequence: int = SEQUENCE,
    open_bins: int = OPEN_BINS,
    group_tokens: int = GROUP_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if wanted, its ids."""
    if open_bins < 1 or group_tokens < 2 * open_bins * sequence:
        raise ValueError("a group needs room for twice its open bins")
    pieces = _pieces(df, path, doc_id, text, end_id, sequence, with_ids)
    short = F.col("length") < sequence
    items = pieces.filter(short).select(F.col("row").alias("item"), F.col("length").alias("size"))
    placed = _placed(items, sequence, open_bins, group_tokens).withColumnRenamed("item", "row")
    whole = pieces.filter(~short).select("row", (F.col("row") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    joined = pieces.join(placed.unionByName(whole), "row")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


@query("op11_best_fit_packing")
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_best_fit(read_table(spark, sf_dir, "documents"), path, with_ids=False)
