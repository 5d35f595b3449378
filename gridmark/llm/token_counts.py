"""Token counts: prefix dynamic programming over byte-pair encodings.

The last token of the encoding of a prefix decides the rest: if the encoding of the first i bytes ends with token t, it
is the encoding of the bytes before t followed by t. So one pass from left to right keeps, for every prefix, its last
token and its number of tokens: at each end the one vocabulary token is taken that fits the last token before it, where
two tokens fit if encoding their joined bytes gives just these two. Every prefix's exact count is then known, so
"how many tokens are the first n characters" and "how far do b tokens reach" need no further encoding.

The pass runs within the pieces that the tokenizer's pattern splits a text into. Pieces repeat much, so each Python
worker keeps the counts of those it has met, up to a fixed number. Texts are handled one by one in Arrow batches: no
shuffle, and memory is bounded by the longest text.

Defined results: a null text counts as empty (0 bytes, 0 tokens, every budget reaches 0 characters); special strings
inside texts are one token, as the tokenizer's default has it; repeated rows are counted alike; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from gridmark.llm.catalogue import query
from gridmark.llm.common import read_table

LIMIT = 1_024
# Pieces whose count a worker remembers, about 60 MB.
REMEMBERED = 400_000

# Unicode white space, and the published pattern of the byte-level tokenizer over it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
_SPLIT = regex.compile(PIECES)
_ALL_SPACE = regex.compile(f"[{SPACE}]+")


def _byte_letters() -> dict[str, int]:
    """The published one-to-one map between bytes and printable letters in vocabulary files."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Exact token counts of all prefixes under one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.specials = sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True)
        self._split_special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        tokens = {t: i for t, i in whole["model"]["vocab"].items() if t not in self.specials}
        self.vocabulary = {as_bytes(t): i for t, i in tokens.items()}
        self.longest = max(map(len, self.vocabulary))
        self.merge_rank = {}
        for rank, merge in enumerate(whole["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merge_rank[as_bytes(left), as_bytes(right)] = rank
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._totals: dict[str, int] = {}

    def encode(self, piece: bytes) -> list[bytes]:
        """Plain byte-pair encoding: merge the pair of lowest rank until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.merge_rank
        while len(parts) > 1:
            best, at = min((rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > REMEMBERED:
                self._fits.clear()
            known = self._fits[left, right] = self.encode(left + right) == [left, right]
        return known

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token counts of the prefixes of 0, 1, ... bytes of one piece."""
        counts, last = [0] * (len(piece) + 1), [b""] * (len(piece) + 1)
        vocabulary, longest = self.vocabulary, self.longest
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = piece[start:end]
                if token in vocabulary and (start == 0 or self.fits(last[start], token)):
                    counts[end], last[end] = counts[start] + 1, token
                    break
        return counts

    def _total(self, piece: str) -> int:
        if len(self._totals) > REMEMBERED:
            self._totals.clear()
        total = self._totals[piece] = self.piece_counts(piece.encode())[-1]
        return total

    def _segments(self, text: str) -> list[str]:
        """The text between special strings."""
        return [text] if self._split_special is None else self._split_special.split(text)

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        segments, known, total = self._segments(text), self._totals, 0
        for segment in segments:
            for piece in _SPLIT.findall(segment):
                n = known.get(piece)
                total += self._total(piece) if n is None else n
        return total + len(segments) - 1

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of the first 0, 1, ... characters, each as if the text ended there."""
        counts, total, place, begun = [0], 0, 0, 0
        for number, segment in enumerate(self._segments(text)):
            if number:
                special = next(s for s in self.specials if text.startswith(s, place))
                # A cut special string is ordinary text and joins the segment before it.
                start = counts[begun]
                for k in range(1, len(special)):
                    counts.append(start + self.count(text[begun : place + k]))
                total += 1
                counts.append(total)
                place = begun = place + len(special)
            total = self._segment_counts(segment, counts, total)
            place += len(segment)
        return counts

    def _segment_counts(self, segment: str, counts: list[int], total: int) -> int:
        spaces = None  # (total before, start) of the run of white space that the current piece may belong to
        place = 0
        for piece in _SPLIT.findall(segment):
            inside = self.piece_counts(piece.encode())
            by_char, at = [], 0
            for char in piece:
                at += len(char.encode())
                by_char.append(inside[at])
            if piece[0] == "'" and len(piece) == 3:
                # Half a contraction is a quote and a letter.
                by_char[1] = by_char[0] + self.piece_counts(piece[1].encode())[-1]
            lead = _ALL_SPACE.match(piece)
            if lead is not None and spaces is None:
                spaces = (total, place)
            if lead is not None and spaces[1] < place:
                # Cut inside a run of white space, the whole run is one piece.
                run = self.piece_counts(segment[spaces[1] : place + lead.end()].encode())
                for k in range(lead.end()):
                    by_char[k] = run[len(segment[spaces[1] : place + k + 1].encode())] + spaces[0] - total
            if lead is None or lead.end() < len(piece):
                spaces = None
            counts.extend(total + c for c in by_char)
            total += inside[-1]
            place += len(piece)
        return total

    def reach(self, text: str, budget: int) -> int:
        """The most characters of *text* whose encoding has at most *budget* tokens."""
        counts = self.prefix_counts(text)
        return next(n for n in range(len(counts) - 1, -1, -1) if counts[n] <= budget)


class PrefixTable:
    """The counts of one text's prefixes, kept for many questions."""

    def __init__(self, counts: list[int]):
        self.counts = counts
        # Counts can fall again, so reach looks at the smallest count from each prefix on.
        self._least = counts[:]
        for i in range(len(counts) - 2, -1, -1):
            self._least[i] = min(self._least[i], self._least[i + 1])

    def tokens(self, characters: int) -> int:
        return self.counts[min(characters, len(self.counts) - 1)]

    def reach(self, budget: int) -> int:
        return bisect.bisect_right(self._least, budget) - 1


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(df: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text. *path* must exist where tasks run."""
    kind = df.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            sizes, totals = [], []
            for value in batch.column(1):
                value = value.as_py() or ""
                sizes.append(len(value.encode()))
                totals.append(own.count(value))
            over = pa.array([t > limit for t in totals], pa.bool_())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), over]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = df.select(f"`{doc_id}`", f"`{text}`")
    return narrow.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def truncation_points(df: DataFrame, path: str, budgets: list[int], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and, for each budget, the characters it reaches, from one prefix table per text."""
    kind = df.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            totals, points = [], []
            for value in batch.column(1):
                table = PrefixTable(own.prefix_counts(value.as_py() or ""))
                totals.append(table.counts[-1])
                points.append([table.reach(b) for b in budgets])
            columns = [batch.column(0), pa.array(totals, pa.int64()), pa.array(points, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "characters"])

    narrow = df.select(f"`{doc_id}`", f"`{text}`")
    return narrow.mapInArrow(cut, f"doc_id {kind}, n_tokens bigint, characters array<bigint>")


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
