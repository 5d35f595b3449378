"""Line dedup by pairwise alignment: delete from later documents the blocks of lines they share with earlier ones.

Lines of some words are hashed. Every line that stands in two documents or more belongs to the earliest of them, so a
document meets only the owners of its own lines: as many pairs as lines at most, however frequent a line is, and a
document's rarest lines bring in its closest relatives. For each pair the shared lines are anchors of a patience diff:
the longest run of anchors that rises in both documents is aligned, and the diff is repeated on the anchors left over,
so that moved passages are found too. Aligned lines that follow each other in both documents form a block; a block of
enough words is deleted from the later document, with those short lines after its lines that are the same in both.

Pieces of one block can have different owners. With ``run_words``, lines of at least so many words are therefore also
hashed in runs: from every such line forward and backward, the shortest run of two or more with the words of a block. A
run that stands in an earlier document is deleted whatever the owners of its lines. Such runs cover every common block of
these lines, as an alignment of all pairs of documents finds it; with 1 word, blocks of short lines too. The query and
the pipeline take MIN_LINE_WORDS. What stays then: blocks that need lines of under 5 words to reach 8 words, passages
that begin or end inside a line, and lines that differ in white space.

Defined results: documents are ordered by id, then by text hash; rows that repeat id and text are one document and get
the same result each; a row without id is neither cleaned nor an owner; a null text stays null; short lines alone are
never shared unless ``run_words`` says so; a document of which nothing but white space remains gets the empty text; repeats within a document stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.llm.catalogue import query
from gridmark.llm.common import GAPS, WORD_PATTERN, fresh, read_table, stored

# Words of a line that can be shared, and of a block that is deleted.
MIN_LINE_WORDS = 5
MIN_BLOCK_WORDS = 8

Match = tuple[int, int, int]  # rank among the long lines, owner's rank, words


def longest_rise(values: list[int]) -> list[int]:
    """Positions of a longest strictly rising subsequence (patience piles with back pointers)."""
    tops: list[int] = []
    pile_of: list[int] = []
    back = [-1] * len(values)
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            pile_of.append(i)
        else:
            tops[pile] = value
            pile_of[pile] = i
        back[i] = pile_of[pile - 1] if pile else -1
    run, i = [], pile_of[-1] if pile_of else -1
    while i >= 0:
        run.append(i)
        i = back[i]
    return run[::-1]


def aligned_blocks(matches: list[Match], min_words: int = MIN_BLOCK_WORDS) -> list[list[int]]:
    """The ranks of the lines of each common block with one owner."""
    left, blocks = sorted(matches), []
    while left:
        run = longest_rise([m[1] for m in left])
        begin = 0
        for k in range(1, len(run) + 1):
            here, last = left[run[k]] if k < len(run) else None, left[run[k - 1]]
            if here is not None and here[0] == last[0] + 1 and here[1] == last[1] + 1:
                continue
            members = [left[i] for i in run[begin:k]]
            if sum(m[2] for m in members) >= min_words:
                blocks.append([m[0] for m in members])
            begin = k
        taken = set(run)
        left = [m for i, m in enumerate(left) if i not in taken]
    return blocks


def _spans(found: list[dict]) -> list[dict]:
    """Spans of lines to delete, from one document's matches."""
    by_owner: dict[tuple[int, int], list[Match]] = {}
    by_rank = {m["rank"]: m for m in found}
    for m in found:
        by_owner.setdefault((m["owner"], m["owner_key"]), []).append((m["rank"], m["owner_rank"], m["words"]))
    spans: list[dict] = []
    for rank in sorted(rank for one in by_owner.values() for block in aligned_blocks(one) for rank in block):
        m = by_rank[rank]
        first = 0 if m["same_head"] else m["line"]
        last = m["stop"] - 1 if m["same_tail"] else m["line"]
        if spans and spans[-1]["last"] + 1 == first:
            spans[-1]["last"] = last
        else:
            spans.append({"first": first, "last": last})
    return spans


def short_runs(counts: list[int], min_words: int = MIN_BLOCK_WORDS) -> list[tuple[int, int]]:
    """First and last of the shortest runs of two items or more with enough words, from every item to both sides."""
    found, last, total = set(), -1, 0
    for first in range(len(counts)):
        while total < min_words and last + 1 < len(counts):
            last += 1
            total += counts[last]
        if total < min_words:
            break
        found.add((first, last))
        total -= counts[first]
    first, total = len(counts), 0
    for last in range(len(counts) - 1, -1, -1):
        while total < min_words and first > 0:
            first -= 1
            total += counts[first]
        if total < min_words:
            break
        found.add((first, last))
        total -= counts[last]
    return sorted(run for run in found if run[0] < run[1])


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _hashed_runs(lines: list[bytes], run_words: int) -> Iterator[tuple[list[dict], int]]:
    """Spans and hash of each run of a document's lines; short lines inside a run go where they are the same too."""
    # Words beyond those of a block do not matter.
    counts = [len(x.split(None, MIN_BLOCK_WORDS)) for x in lines]
    places = [i for i, n in enumerate(counts) if n >= run_words]
    number = lambda kind, some: int.from_bytes(
        blake2b(kind + b"\n".join(lines[i] for i in some), digest_size=8).digest(), "little", signed=True
    )
    for begin, end in short_runs([counts[i] for i in places]):
        members = places[begin : end + 1]
        first, last = members[0], members[-1]
        filled = [i for i in range(first, last + 1) if counts[i]]
        whole = [{"first": first, "last": last}]
        if filled == members:
            yield whole, number(b"L", members)
        else:
            yield [{"first": i, "last": i} for i in members], number(b"L", members)
            yield whole, number(b"S", filled)


def _run_spans(df: DataFrame, doc_id: str, text: str, run_words: int) -> DataFrame:
    """``id, text_key, spans`` of the runs of lines that an earlier document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans, hashes = [], [], []
            for row, value in enumerate(batch.column(2)):
                for some, number in _hashed_runs(value.as_buffer().to_pybytes().split(b"\n"), run_words):
                    rows.append(row)
                    spans.append(some)
                    hashes.append(number)
            at = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(spans, _SPANS), pa.array(hashes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "spans", "hash"])

    value = F.col(f"`{text}`")
    rows = df.filter(F.col(f"`{doc_id}`").isNotNull() & value.isNotNull())
    rows = rows.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.xxhash64(value).alias("text_key"), value.alias("text"))
    kind = "id bigint, text_key bigint, spans array<struct<first: int, last: int>>, hash bigint"
    found = stored(rows.mapInArrow(run, kind), "line-runs")
    place = F.struct("id", "text_key")
    owners = found.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low != high")
    later = found.join(stored(owners.select("hash", "low"), "run-owners"), "hash").filter(place != F.col("low"))
    return later.select("id", "text_key", "spans")


def _joined(spans: DataFrame) -> DataFrame:
    """One row per document with its spans in order, those that touch as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(2).to_pylist():
                whole: list[dict] = []
                for s in sorted(found, key=lambda s: (s["first"], s["last"])):
                    if whole and s["first"] <= whole[-1]["last"] + 1:
                        whole[-1]["last"] = max(whole[-1]["last"], s["last"])
                    else:
                        whole.append(s)
                out.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _SPANS)], ["id", "text_key", "spans"])

    grouped = spans.groupBy("id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return grouped.mapInArrow(run, "id bigint, text_key bigint, spans array<struct<first: int, last: int>>")


def _deletions(matches: DataFrame) -> DataFrame:
    """``id, text_key, spans`` with the spans of lines to delete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            spans = pa.array([_spans(found) for found in batch.column(2).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans], ["id", "text_key", "spans"])

    members = F.struct("rank", "line", "stop", "owner", "owner_key", "owner_rank", "words", "same_tail", "same_head")
    grouped = matches.groupBy("id", "text_key").agg(F.collect_set(members).alias("found"))
    return grouped.mapInArrow(run, "id bigint, text_key bigint, spans array<struct<first: int, last: int>>")


def _long_lines(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row per long line: its place, hash and words, and hashes of the short lines around it."""
    value = F.col(f"`{text}`")
    rows = df.filter(F.col(f"`{doc_id}`").isNotNull() & value.isNotNull()).select(
        F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.xxhash64(value).alias("text_key"), F.split(value, "\n").alias("lines")
    )
    measured = F.transform(
        "lines", lambda x, i: F.struct(i.alias("line"), F.regexp_count(x, F.lit(WORD_PATTERN)).alias("words"))
    )
    rows = rows.withColumn("long", F.filter(measured, lambda x: x["words"] >= MIN_LINE_WORDS))
    stop = lambda k: F.coalesce(F.get("long", k + 1)["line"], F.size("lines"))
    rows = rows.select(
        "id",
        "text_key",
        F.posexplode(
            F.transform(
                "long",
                lambda x, k: F.struct(
                    x["line"].alias("line"),
                    stop(k).alias("stop"),
                    x["words"].alias("words"),
                    F.xxhash64(F.get("lines", x["line"])).alias("hash"),
                    F.xxhash64(F.slice("lines", x["line"] + 2, stop(k) - x["line"] - 1)).alias("tail"),
                    F.when(k == 0, F.xxhash64(F.slice("lines", F.lit(1), x["line"]))).alias("head"),
                ),
            )
        ).alias("rank", "x"),
    )
    return rows.select("id", "text_key", "rank", "x.*")


def dedup_lines(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", out: str = "deleted_lines", run_words: int | None = None
) -> DataFrame:
    """*df* with cleaned *text* and a new column *out*: how many of its lines were deleted."""
    taken = [*df.columns, out]
    names = {n: fresh(n, taken) for n in ("id_of_row", "key_of_row", "id", "text_key", "spans", "lines")}
    value = F.col(f"`{text}`")
    slim = stored(_long_lines(df, doc_id, text), "line-hashes")
    owners = slim.groupBy("hash").agg(
        F.min(F.struct("id", "text_key", "rank", "tail", "head")).alias("low"),
        F.max(F.struct("id", "text_key")).alias("high"),
    )
    owners = owners.filter((F.col("low.id") != F.col("high.id")) | (F.col("low.text_key") != F.col("high.text_key")))
    owners = owners.select(
        "hash",
        *[F.col(f"low.{old}").alias(new) for old, new in (("id", "owner"), ("text_key", "owner_key"), ("rank", "owner_rank"),
                                                          ("tail", "owner_tail"), ("head", "owner_head"))],
    )
    matches = slim.join(stored(owners, "line-owners"), "hash")
    matches = matches.filter((F.col("id") != F.col("owner")) | (F.col("text_key") != F.col("owner_key"))).select(
        "*",
        (F.col("tail") == F.col("owner_tail")).alias("same_tail"),
        F.coalesce(F.col("head") == F.col("owner_head"), F.lit(False)).alias("same_head"),
    )
    spans = _deletions(matches).filter(F.size("spans") > 0)
    if run_words is not None:
        spans = _joined(spans.unionByName(_run_spans(df, doc_id, text, run_words)))
    spans = spans.select(*[F.col(c).alias(names[c]) for c in ("id", "text_key", "spans")])

    rows = df.withColumn(names["id_of_row"], F.col(f"`{doc_id}`").cast("bigint")).withColumn(
        names["key_of_row"], F.xxhash64(value)
    )
    joined = rows.join(
        spans,
        (F.col(names["id_of_row"]) == F.col(names["id"])) & (F.col(names["key_of_row"]) == F.col(names["text_key"])),
        "left",
    ).withColumn(names["lines"], F.split(value, "\n"))
    gone = F.col(names["spans"])
    kept = F.filter(
        F.col(names["lines"]), lambda x, i: ~F.exists(gone, lambda s: (i >= s["first"]) & (i <= s["last"]))
    )
    joined = joined.withColumn(names["lines"], F.when(gone.isNotNull(), F.struct(F.size(names["lines"]).alias("n"), kept.alias("kept"))))
    left = F.col(f"{names['lines']}.kept")
    cleaned = F.array_join(left, "\n")
    cleaned = F.when(F.length(F.translate(cleaned, GAPS, "")) == 0, "").otherwise(cleaned)
    changed = F.col(names["lines"]).isNotNull()
    shown = [
        F.when(changed, cleaned).otherwise(value).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns
    ]
    count = F.when(changed, F.col(f"{names['lines']}.n") - F.size(left)).otherwise(0)
    return joined.select(*shown, count.cast("bigint").alias(out))


def without_shared_lines(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """*df* with cleaned texts and its own columns; documents of which nothing remains are left out."""
    out = fresh("deleted_lines", df.columns)
    cleaned = dedup_lines(df, doc_id=doc_id, text=text, out=out, run_words=MIN_LINE_WORDS)
    return cleaned.filter((F.col(f"`{out}`") == 0) | (F.col(f"`{text}`") != "")).drop(out)


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cleaned text."""
    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), run_words=MIN_LINE_WORDS)
