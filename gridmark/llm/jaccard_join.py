"""N-gram Jaccard join with adaptive multi-match prefixes, and the near-duplicate classes that its links make.

A document's set holds the hashes of its distinct five-word shingles, ordered from rare to frequent by a count sketch
over all documents. For a level m, its prefix is all but the last ceil(0.8 n) - m shingles, and two documents of
similarity 0.8 share at least m shingles of their prefixes at any level m both reach. Each document picks the level whose
estimated cost (postings read, plus verified candidates, of which every one must use up m postings) is least; a pair
is a candidate when it shares as many prefix shingles as the lower of its two levels, at places that leave room for
the overlap that 0.8 needs.

Work: (1) one pass counts shingles into the sketch and writes a fingerprint of every document's set; (2) one pass sends
prefixes, packed by shingle bucket, to tasks that keep the lists of two documents or more; copies of a set count once;
(3) in every list the set in which the shingle comes first (it has the fewest rarer ones) is the leader; pairs with
leaders are verified on whole texts and linked, which joins large families by as many pairs as they have members; (4) in
the lists whose classes still differ, all pairs across classes that share enough are verified in the same way.
So every document that a link can reach is reached, though not every link within a class is spelled out. Lists
of very frequent shingles are dealt in blocks, each pair of blocks to a task of its own.

Defined results: no words or no text: empty set, linked with nothing; fewer than five words: the whole sequence is the
one shingle; equal sets are linked; a row without id links with nothing and has no class; rows that repeat an id share
the class of that id's rows only through links; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.llm import sketch
from gridmark.llm.catalogue import query
from gridmark.llm.common import read_table, stored
from gridmark.llm.components import components
from gridmark.llm.shingles import mix, shingle_sets

MAX_LEVEL = 8
# Documents of one shingle's list that a task compares; longer lists are dealt in blocks of this size.
LIST_BLOCK = 20_000
# Postings of lists with several classes that one task compares.
CROSS_POSTINGS = 200_000
# Candidates for one document cost about its length; a posting costs one.
VERIFY_COST = 0.1
_PACK = np.dtype([("token", "<u8"), ("cid", "<i8"), ("n", "<u4"), ("place", "<u4"), ("part", "<u4"), ("block", "<u2"),
                  ("level", "u1")])


def _pack(postings: np.ndarray) -> bytes:
    """Field by field, which compresses better than posting by posting."""
    return b"".join(postings[name].tobytes() for name in _PACK.names)


def _unpack(blob: bytes) -> np.ndarray:
    count, at = len(blob) // _PACK.itemsize, 0
    postings = np.empty(count, dtype=_PACK)
    for name in _PACK.names:
        postings[name] = np.frombuffer(blob, _PACK[name], count, at)
        at += count * _PACK[name].itemsize
    return postings


def needed(n: np.ndarray | int):
    """Shingles that a set of n must share with any set of similarity 0.8."""
    return (4 * n + 4) // 5


def fingerprint(tokens: np.ndarray) -> int:
    """One number for a set, 0 only for the empty one."""
    if len(tokens) == 0:
        return 0
    value = mix(np.array([np.add.reduce(mix(tokens)) ^ np.uint64(len(tokens))], dtype=np.uint64))
    return int(value.view(np.int64)[0]) or 1


def choose_level(frequency: np.ndarray, n: int) -> int:
    """The level of least estimated cost; *frequency* is in prefix order."""
    top = min(MAX_LEVEL, int(needed(n)))
    base = n - int(needed(n))
    read = np.cumsum(frequency)[base : base + top]
    others = np.cumsum(frequency - 1)[base : base + top]
    levels = np.arange(1, top + 1)
    return int(np.argmin(read + VERIFY_COST * n * others / levels)) + 1


def _profiles(df: DataFrame) -> DataFrame:
    """Rows of two kinds: (doc_id, n, cid) of a document, and blocks of the task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.TaskCounts()
        names = ["doc_id", "n", "cid", "block", "places", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            ids, sizes, prints, seen, held = batch.column(0).to_pylist(), [], [], [], 0
            for _, tokens in shingle_sets(batch.column(1)):
                sizes.append(len(tokens))
                prints.append(fingerprint(tokens))
                seen.append(tokens)
                held += len(tokens)
                if held > 300_000:
                    counts.add(np.concatenate(seen))
                    seen, held = [], 0
            if seen:
                counts.add(np.concatenate(seen))
            empty = [None] * len(ids)
            columns = [ids, sizes, prints, empty, empty, empty]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        for block, places, numbers in counts.blocks():
            row = [None, None, None, block, places, numbers]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], names)

    return df.mapInArrow(run, f"doc_id bigint, n bigint, cid bigint, {sketch.BLOCK_SCHEMA}")


def _parts_of(entry: np.ndarray, frequency: np.ndarray, list_block: int) -> np.ndarray:
    """Copies of postings for the blocks of long lists: block b goes to the parts (b, x) and (x, b)."""
    splits = np.ceil(frequency / list_block).astype(np.int64)
    plain = entry[splits <= 1]
    long = entry[splits > 1]
    if not len(long):
        return plain
    pieces = [plain]
    for posting, s in zip(long, splits[splits > 1], strict=True):
        own = int(np.uint64(posting["cid"].astype(np.uint64)) % np.uint64(s))
        copies = np.repeat(posting[None], s, axis=0)
        other = np.arange(s)
        copies["block"] = own
        copies["part"] = np.minimum(own, other) * s + np.maximum(own, other) + 1
        pieces.append(copies)
    return np.concatenate(pieces)


def _packed_prefixes(df: DataFrame, totals: np.ndarray, buckets: int, list_block: int) -> DataFrame:
    """(bucket, postings): prefixes of all documents with an id and a set, packed by shingle bucket."""
    shared = df.sparkSession.sparkContext.broadcast(totals.astype(np.float32))
    mean = float(totals.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        held: list[np.ndarray] = []
        size = 0

        def flush():
            whole = np.concatenate(held)
            where = (whole["token"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            whole, where = whole[order], where[order]
            cuts = np.flatnonzero(np.diff(where)) + 1
            blobs = [_pack(p) for p in np.split(whole, cuts)]
            firsts = where[np.concatenate([[0], cuts])]
            return pa.RecordBatch.from_arrays([pa.array(firsts, pa.int32()), pa.array(blobs, pa.binary())],
                                              names=["bucket", "postings"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, tokens in shingle_sets(batch.column(1)):
                n = len(tokens)
                if n == 0 or ids[row] is None:
                    continue
                seen = counts[sketch.bucket_of(tokens)]
                # A bucket's count less its average load estimates the shingle's own documents.
                frequency = np.maximum(seen - mean, 1.0)
                rank = np.log2(frequency).astype(np.int64)
                # Rank by halving steps of frequency, then by hash, is one order for all documents.
                order = np.argsort((rank.astype(np.uint64) << np.uint64(58)) | (tokens >> np.uint64(6)), kind="stable")
                level = choose_level(frequency[order], n)
                used = order[: n - int(needed(n)) + level]
                entry = np.zeros(len(used), dtype=_PACK)
                entry["token"], entry["cid"], entry["n"] = tokens[used], fingerprint(tokens), n
                entry["place"], entry["level"] = np.arange(len(used)), level
                entry = _parts_of(entry, seen[used], list_block)
                held.append(entry)
                size += entry.nbytes
                if size > 6_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return df.mapInArrow(run, "bucket int, postings binary")


def _keep_lists(table: pa.Table) -> pa.Table:
    """One bucket: postings in list order, copies of a set once, lists of one left out."""
    whole = np.concatenate([_unpack(b) for b in table["postings"].to_pylist()])
    whole = whole[np.lexsort((whole["cid"], whole["part"], whole["token"]))]
    new = np.ones(len(whole), dtype=bool)
    same_list = (whole["token"][1:] == whole["token"][:-1]) & (whole["part"][1:] == whole["part"][:-1])
    new[1:] = ~(same_list & (whole["cid"][1:] == whole["cid"][:-1]))
    whole = whole[new]
    same_list = (whole["token"][1:] == whole["token"][:-1]) & (whole["part"][1:] == whole["part"][:-1])
    several = np.zeros(len(whole), dtype=bool)
    several[1:] |= same_list
    several[:-1] |= same_list
    whole = whole[several]
    rows = [[table["bucket"][0].as_py()], [_pack(whole)]] if len(whole) else [[], []]
    return pa.table([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], names=["bucket", "postings"])


def _list_starts(whole: np.ndarray) -> np.ndarray:
    new = (whole["token"][1:] != whole["token"][:-1]) | (whole["part"][1:] != whole["part"][:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _may_match(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two postings of a shingle can be among the first shared ones of a pair of similarity 0.8."""
    nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
    px, py = x["place"].astype(np.int64), y["place"].astype(np.int64)
    level = np.minimum(x["level"], y["level"]).astype(np.int64)
    overlap = (4 * (nx + ny) + 8) // 9
    return (
        (5 * nx >= 4 * ny)
        & (5 * ny >= 4 * nx)
        & (px < nx - needed(nx) + level)
        & (py < ny - needed(ny) + level)
        & (np.minimum(nx - px, ny - py) + level - 1 >= overlap)
    )


_PAIRS = np.dtype([("a", "<i8"), ("b", "<i8"), ("level", "<i8")])
_PAIR_SCHEMA = "a bigint, b bigint, level bigint, shared bigint"


def _pair_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    swap = x["cid"] > y["cid"]
    out = np.zeros(len(x), dtype=_PAIRS)
    out["a"], out["b"] = np.where(swap, y["cid"], x["cid"]), np.where(swap, x["cid"], y["cid"])
    out["level"] = np.minimum(x["level"], y["level"])
    return out


def _counted(pairs: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Distinct pairs and how often each was found."""
    found = np.concatenate(pairs) if pairs else np.zeros(0, dtype=_PAIRS)
    order = np.lexsort((found["b"], found["a"]))
    a, b = found["a"][order], found["b"][order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    shared = np.diff(np.append(first, len(a)))
    return {"a": a[first], "b": b[first], "level": found["level"][order[first]], "shared": shared}


def _leader_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (leader, member) of every list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1):
                whole = _unpack(blob.as_py())
                starts = _list_starts(whole)
                sizes = np.diff(np.append(starts, len(whole)))
                number = np.repeat(np.arange(len(starts)), sizes)
                leaders = np.lexsort((whole["cid"], whole["place"], number))[starts]
                head = whole[np.repeat(leaders, sizes)]
                ok = (head["cid"] != whole["cid"]) & _may_match(head, whole)
                if ok.any():
                    yield pa.RecordBatch.from_pydict(_counted([_pair_rows(head[ok], whole[ok])]))

    return lists.mapInArrow(run, _PAIR_SCHEMA).select("a", "b").distinct()


def _mixed_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists whose members are in different classes: (postings, labels)."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(batch.column(0), batch.column(1), strict=True):
                cids = np.unique(_unpack(blob.as_py())["cid"])
                columns = [pa.array(np.full(len(cids), bucket.as_py()), pa.int32()), pa.array(cids, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "node"])

    def tag(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes, tags = right["node"].to_numpy(), right["label"].to_numpy()
        order = np.argsort(nodes)
        nodes, tags = nodes[order], tags[order]
        out: list[list[bytes]] = [[], []]
        for blob in left["postings"].to_pylist():
            whole = _unpack(blob)
            label = whole["cid"].copy()
            if len(nodes):
                at = np.minimum(np.searchsorted(nodes, label), len(nodes) - 1)
                label = np.where(nodes[at] == label, tags[at], label)
            starts = _list_starts(whole)
            mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
            kept = np.repeat(mixed, np.diff(np.append(starts, len(whole))))
            if kept.any():
                out[0].append(_pack(whole[kept]))
                out[1].append(label[kept].tobytes())
        return pa.table([pa.array(c, pa.binary()) for c in out], names=["postings", "labels"])

    tagged = lists.mapInArrow(members, "bucket int, node bigint").join(labels, "node")
    return lists.groupBy("bucket").cogroup(tagged.groupBy("bucket")).applyInArrow(tag, "postings binary, labels binary")


def _cross_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs of members of different classes in every list, and how many lists of a task they share."""
    held = mixed.agg(F.sum(F.length("labels") / 8)).first()[0] or 0
    # Few large tasks count most of a pair's lists in one place.
    tasks = int(held // CROSS_POSTINGS) + 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, tags in zip(batch.column(0), batch.column(1), strict=True):
                whole, label = _unpack(blob.as_py()), np.frombuffer(tags.as_py(), "<i8")
                where = (mix(whole["token"]) % np.uint64(tasks)).astype(np.int64)
                for task in np.unique(where):
                    own = where == task
                    columns = [pa.array([task], pa.int32()), pa.array([_pack(whole[own])], pa.binary()),
                               pa.array([label[own].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["task", "postings", "labels"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, blob in zip(batch.column(0), batch.column(1), strict=True):
                cids, n = np.unique(_unpack(blob.as_py())["cid"], return_counts=True)
                columns = [pa.array(np.full(len(cids), task.as_py()), pa.int32()), pa.array(cids), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["task", "cid", "here"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs: list[np.ndarray] = []
        for blob, tags in zip(left["postings"].to_pylist(), left["labels"].to_pylist(), strict=True):
            whole, label = _unpack(blob), np.frombuffer(tags, "<i8")
            starts = _list_starts(whole)
            ends = np.append(starts[1:], len(whole))
            # Lists of two, the most by far, at once; then the others one by one.
            twos = starts[(ends - starts == 2) & (whole["part"][starts] == 0)]
            ok = (label[twos] != label[twos + 1]) & _may_match(whole[twos], whole[twos + 1])
            pairs.append(_pair_rows(whole[twos][ok], whole[twos + 1][ok]))
            more = (ends - starts > 2) | (whole["part"][starts] > 0)
            for begin, end in zip(starts[more], ends[more], strict=True):
                one, own = whole[begin:end], label[begin:end]
                for i in range(len(one) - 1):
                    apart = own[i + 1 :] != own[i]
                    if one["part"][0]:
                        apart = apart & _meets_here(one, i)
                    rest = one[i + 1 :][apart]
                    head = np.repeat(one[i : i + 1], len(rest))
                    ok = _may_match(head, rest)
                    if ok.any():
                        pairs.append(_pair_rows(head[ok], rest[ok]))
        counted = _counted(pairs)
        # A pair goes on if its lists here, and as many as both can have in other tasks, make up its level.
        cids, rest = right["cid"].to_numpy(), right["total"].to_numpy() - right["here"].to_numpy()
        order = np.argsort(cids)
        cids, rest = cids[order], rest[order]
        elsewhere = np.minimum(*(rest[np.searchsorted(cids, counted[side])] for side in "ab"))
        enough = counted["shared"] + elsewhere >= counted["level"]
        return pa.table({name: values[enough] for name, values in counted.items()})

    dealt = mixed.mapInArrow(spread, "task int, postings binary, labels binary")
    here = dealt.mapInArrow(members, "task int, cid bigint, here bigint")
    here = here.groupBy("task", "cid").agg(F.sum("here").alias("here"))
    totals = here.groupBy("cid").agg(F.sum("here").alias("total"))
    here = here.join(totals, "cid")
    return dealt.groupBy("task").cogroup(here.groupBy("task")).applyInArrow(compare, _PAIR_SCHEMA)


def _meets_here(one: np.ndarray, i: int) -> np.ndarray:
    """In a part for two blocks, pairs across them; in a part for one block, all pairs."""
    blocks = np.unique(one["block"])
    others = one["block"][i + 1 :]
    return np.ones(len(others), dtype=bool) if len(blocks) == 1 else others != one["block"][i]


def _candidates(pairs: DataFrame) -> DataFrame:
    grouped = pairs.groupBy("a", "b").agg(F.min("level").alias("level"), F.sum("shared").alias("shared"))
    return grouped.filter(F.col("shared") >= F.col("level")).select("a", "b")


def _wanted_texts(df: DataFrame, candidates: DataFrame, firsts: DataFrame) -> DataFrame:
    """(cid, text) of the candidates' sets. A bit table of fixed size thins the texts before they move."""
    cids = candidates.select(F.col("a").alias("cid")).union(candidates.select("b")).distinct()
    ids = cids.join(firsts, "cid").select("low")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.TaskCounts()
        for batch in batches:
            counts.add(mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        for block, places, numbers in counts.blocks():
            columns = [pa.array([block], pa.int32()), pa.array([places], pa.binary()), pa.array([numbers], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "places", "counts"])

    marked = df.sparkSession.sparkContext.broadcast(sketch.add_up(ids.mapInArrow(mark, sketch.BLOCK_SCHEMA)) > 0)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            hashed = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            batch = batch.filter(pa.array(marked.value[sketch.bucket_of(hashed)]))
            prints = [fingerprint(tokens) for _, tokens in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), batch.column(1)], ["cid", "text"])

    texts = df.mapInArrow(thin, "cid bigint, text string")
    return texts.groupBy("cid").agg(F.first("text").alias("text"))


def _verified(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidates (a, b) whose whole sets have similarity 0.8 or more."""
    seconds = candidates.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
    both = seconds.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = None, None
        for batch in batches:
            keep = []
            ids = batch.column(0).to_numpy()
            for row, tokens in shingle_sets(batch.column(2)):
                if ids[row] != known:
                    known, first = ids[row], next(shingle_sets(batch.column(3).slice(row, 1)))[1]
                common = len(np.intersect1d(first, tokens, assume_unique=True))
                keep.append(100 * common >= 80 * (len(first) + len(tokens) - common))
            kept = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if kept.num_rows:
                yield kept

    return both.select("a", "b", "text_b", "text_a").mapInArrow(run, "a bigint, b bigint")


def near_duplicate_classes(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", list_block: int = LIST_BLOCK
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; component_id is the smallest id reachable by links."""
    spark = df.sparkSession
    narrow = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = stored(_profiles(narrow), "jaccard-profiles")
    counts = sketch.add_up(rows.filter("block is not null").select("block", "places", "counts"))
    profiles = rows.filter("block is null").select("doc_id", "n", "cid")

    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 4
    packed = _packed_prefixes(narrow, counts, buckets, list_block)
    lists = stored(packed.groupBy("bucket").applyInArrow(_keep_lists, "bucket int, postings binary"), "jaccard-lists")

    own = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    firsts = stored(profiles.filter(own).groupBy("cid").agg(F.min("doc_id").alias("low")), "jaccard-sets")
    first = stored(_leader_pairs(lists), "jaccard-leaders")
    links = stored(_verified(first, _wanted_texts(narrow, first, firsts)), "jaccard-links")
    mixed = stored(_mixed_lists(lists, components(links)), "jaccard-mixed")
    cross = stored(_candidates(_cross_pairs(mixed)).join(first, ["a", "b"], "left_anti"), "jaccard-cross")
    if not cross.isEmpty():
        more = _verified(cross, _wanted_texts(narrow, cross, firsts))
        links = links.unionByName(stored(more, "jaccard-links"))
    return _labelled(profiles, firsts, components(links))


def _labelled(profiles: DataFrame, firsts: DataFrame, labels: DataFrame) -> DataFrame:
    own = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classes = firsts.join(labels, F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cid"))
    lowest = classes.groupBy("label").agg(F.min("low").alias("component"))
    classes = classes.join(lowest, "label").select("cid", "component")
    component: Column = F.when(own, F.col("component")).otherwise(F.col("doc_id"))
    return profiles.join(classes, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicate_classes(read_table(spark, sf_dir, "documents"))
