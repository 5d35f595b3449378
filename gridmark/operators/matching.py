"""Greedy matching of detections to ground truth, for one overlap threshold or a whole grid of them at once.

A *lane* is one (overlap threshold, area range) pair. All lanes of a pair of boxes are decided together: a candidate
carries a bit mask of the lanes it may serve, so the grid costs one pass instead of one matching per threshold.

Detections and ground truths of an (image, class) group meet in one shuffle, which also counts them. Small groups are
gathered there and folded by a native ``aggregate``. Groups above ``GROUP_ROW_LIMIT`` are never gathered: their rows are
put aside in the same pass, their candidates come from a grid join, and each lane's *wishes* (candidate pairs) are settled
in one task while they are few, else by rounds. A round settles every pair in which a detection's best remaining ground
truth has no better-ranked wisher left, and only wishes that are still open go on. Since all ground truths rank detections
the same way, both end in exactly the greedy result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark import scale
from gridmark.functions import boxes as bx

# Published area ranges in square pixels, and the cap that keeps a threshold of 1 reachable.
AREA_RANGES = {"all": (0.0, 1e10), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, 1e10)}
THRESHOLD_CAP = 1 - 1e-10
GROUP = ["image_id", "label"]
# Wishes of one lane of a large group that one task settles in turn.
IN_TURN = 100_000


@dataclass(frozen=True)
class Lanes:
    """The grid of thresholds and area ranges that is matched in one pass; at most 63 lanes."""

    thresholds: tuple[float, ...] = (0.5,)
    areas: tuple[tuple[str, float, float], ...] = ()
    crowd_rule: str = "iou"
    later_wins: bool = False

    def __post_init__(self) -> None:
        if self.crowd_rule not in ("iou", "coverage"):
            raise ValueError(f"crowd_rule must be 'iou' or 'coverage', got {self.crowd_rule!r}")
        if not 0 < len(self) < 64:
            raise ValueError("between 1 and 63 lanes fit into one pass; split the thresholds into several passes")
        if min(self.thresholds) <= 0:
            # At 0 every pair of a group would match, touching or not; that is no matching but an all-pairs join.
            raise ValueError("overlap thresholds must be positive")

    def __len__(self) -> int:
        return len(self.thresholds) * max(1, len(self.areas))

    def lane(self, threshold_position: int, area_position: int) -> int:
        return area_position * len(self.thresholds) + threshold_position

    @property
    def every(self) -> int:
        return (1 << len(self)) - 1

    def reached(self, overlap: str) -> str:
        """SQL of the mask of the lanes whose threshold the expression *overlap* reaches."""
        areas = range(max(1, len(self.areas)))
        branches, mask = [], 0
        for threshold, position in sorted((t, i) for i, t in enumerate(self.thresholds)):
            mask |= sum(1 << self.lane(position, a) for a in areas)
            branches.insert(0, f"WHEN {overlap} >= {threshold!r}D THEN {mask}L")
        return f"(CASE {' '.join(branches)} ELSE 0L END)"

    def inside(self, area: str) -> str:
        """SQL of the mask of the lanes whose area range holds the expression *area*."""
        if not self.areas:
            return f"{self.every}L"
        terms = []
        for position, (_, low, high) in enumerate(self.areas):
            bits = sum(1 << self.lane(t, position) for t in range(len(self.thresholds)))
            terms.append(f"CASE WHEN {area} >= {low!r}D AND {area} <= {high!r}D THEN {bits}L ELSE 0L END")
        return f"({' | '.join(terms)})"

    def names(self) -> dict[str, Column]:
        """Columns ``iou`` and ``area_range`` of a row's ``lane`` number."""
        thresholds = ", ".join(f"{float(t)!r}D" for t in self.thresholds)
        areas = ", ".join(f"'{a[0]}'" for a in self.areas) or "'all'"
        size = len(self.thresholds)
        return {
            "iou": F.expr(f"get(array({thresholds}), lane % {size})"),
            "area_range": F.expr(f"get(array({areas}), lane div {size})"),
        }


def lane_passes(thresholds: Sequence[float], area_names: Sequence[str]) -> list[Sequence[float]]:
    """Thresholds in as many runs as it takes for each to fit into one pass of at most 63 lanes."""
    size = 63 // max(1, len(area_names))
    return [thresholds[i : i + size] for i in range(0, len(thresholds), size)]


def coco_lanes(thresholds: Sequence[float], area_names: Sequence[str] = ("all", "small", "medium", "large")) -> Lanes:
    """Lanes of the published protocol: capped thresholds, crowd coverage, later ground truth wins a tie."""
    areas = tuple((n, *AREA_RANGES[n]) for n in area_names)
    return Lanes(tuple(min(t, THRESHOLD_CAP) for t in thresholds), areas, "coverage", True)


def rank_detections(detections: DataFrame, limit: int | None = None) -> DataFrame:
    """Rank per image and class by score, ties by det_idx, NaN last; keep the first *limit*."""
    order = Window.partitionBy(*GROUP).orderBy(F.isnan("score"), F.col("score").desc(), "det_idx")
    ranked = detections.withColumn("rank", F.row_number().over(order))
    # Spark limits groups before the shuffle only for a filter on the row number itself.
    kept = ranked if limit is None else ranked.filter(F.col("rank") <= limit)
    return kept.withColumn("rank", F.col("rank") - 1)


def overlap_pairs(detections: DataFrame, ground_truth: DataFrame, minimum: float = 0.0) -> DataFrame:
    """IoU of every detection with the ground truths of its own image and class, never across them."""
    right = ground_truth.select(
        *GROUP, "gt_idx", *bx.box().named("gx1", "gy1", "gx2", "gy2"), F.col("iscrowd").alias("gt_crowd")
    )
    joined = detections.join(right, GROUP)
    truth = bx.Box(*[F.col(c) for c in ("gx1", "gy1", "gx2", "gy2")])
    pairs = joined.withColumns({"iou": bx.iou(bx.box(), truth), "coverage": bx.coverage(bx.box(), truth)})
    return pairs.filter(F.col("iou") >= minimum) if minimum > 0 else pairs


# --- shared preparation ----------------------------------------------------------------------------------------------

_AREA = "(x2 - x1) * (y2 - y1)"


_CORNERS = ("x1", "y1", "x2", "y2")


def _carried(names: Sequence[str]) -> list[str]:
    return [f"CAST({n} AS DOUBLE) AS {n}" if n in _CORNERS else n for n in names]


def _detection_columns(detections: DataFrame, lanes: Lanes, carried: Sequence[str]) -> DataFrame:
    area = "CAST(area AS DOUBLE)" if "area" in detections.columns else _AREA
    return detections.selectExpr(
        *GROUP,
        "CAST(det_idx AS BIGINT) AS det_idx",
        "CAST(score AS DOUBLE) AS score",
        *_carried(carried),
        f"{lanes.inside(area)} AS in_range",
    )


def _truth_columns(ground_truth: DataFrame, lanes: Lanes, carried: Sequence[str]) -> DataFrame:
    area = "CAST(area AS DOUBLE)" if "area" in ground_truth.columns else _AREA
    return ground_truth.selectExpr(
        *GROUP,
        "CAST(gt_idx AS BIGINT) AS gt_idx",
        *_carried(carried),
        "coalesce(iscrowd, false) AS crowd",
        f"CASE WHEN iscrowd THEN 0L ELSE {lanes.inside(area)} END AS regular",
    )


# --- plan 1: fold ----------------------------------------------------------------------------------------------------

# Detections of a row are ordered by (signed, det_idx): signed is minus the score, so NaN, the largest double, is last.
# One step: a candidate takes the lanes it may serve that are still open and that its ground truth has not given away.
_FOLD = """
aggregate(
  dets,
  named_struct('used', array_repeat(0L, size(gts)), 'out', CAST(array() AS array<struct<tp:bigint,ig:bigint>>)),
  (s, d) -> CASE WHEN size(d.cands) = 0
    THEN named_struct('used', s.used, 'out', concat(s.out, array(named_struct('tp', 0L, 'ig', 0L))))
    ELSE transform(
    array(aggregate(
      d.cands,
      named_struct('open', {every}L, 'tp', 0L, 'ig', 0L, 'used', s.used),
      (a, c) -> transform(
        array(a.open & c.mask & ~(CASE WHEN c.reusable THEN 0L ELSE element_at(a.used, c.pos) END)),
        take -> named_struct(
          'open', a.open & ~take,
          'tp', CASE WHEN c.ignored THEN a.tp ELSE a.tp | take END,
          'ig', CASE WHEN c.ignored THEN a.ig | take ELSE a.ig END,
          'used', CASE WHEN take = 0L OR c.reusable THEN a.used
                       ELSE transform(a.used, (u, i) -> CASE WHEN i + 1 = c.pos THEN u | take ELSE u END) END
        )
      )[0]
    )),
    r -> named_struct('used', r.used, 'out', concat(s.out, array(named_struct('tp', r.tp, 'ig', r.ig))))
  )[0] END
).out
"""

# Regular lanes first, then ignored ones; inside each by overlap, ties by ground-truth order.
_CANDIDATES = """
array_sort(flatten(transform({near}, c -> filter(array(
  named_struct('ignored', false, 'signed', -c.overlap, 'tie', {tie}, 'pos', c.pos,
               'mask', {reach} & c.regular, 'reusable', c.crowd),
  named_struct('ignored', true, 'signed', -c.overlap, 'tie', {tie}, 'pos', c.pos,
               'mask', {reach} & ~c.regular, 'reusable', c.crowd)
), e -> e.mask <> 0L))))
"""

# Overlaps of one detection with the ground truths of its group that touch it.
_TOUCHING = """
filter(transform(filter(transform(gts, (g, i) -> named_struct(
    'inter', greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0D) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0D),
    'size', (g.x2 - g.x1) * (g.y2 - g.y1), 'pos', i + 1, 'regular', g.regular, 'crowd', g.crowd)),
  t -> t.inter > 0D),
  t -> named_struct('overlap', {overlap}, 'pos', t.pos, 'regular', t.regular, 'crowd', t.crowd)),
  o -> o.overlap >= {minimum!r}D)
"""


def _candidates(near: str, lanes: Lanes) -> str:
    tie = "-c.pos" if lanes.later_wins else "c.pos"
    return _CANDIDATES.format(near=near, tie=tie, reach=lanes.reached("c.overlap"))


def _touching(lanes: Lanes) -> str:
    own = "((d.x2 - d.x1) * (d.y2 - d.y1))"
    overlap = f"t.inter / greatest({own} + t.size - t.inter, {bx.TINY_AREA!r}D)"
    if lanes.crowd_rule == "coverage":
        overlap = f"CASE WHEN t.crowd THEN t.inter / {own} ELSE {overlap} END"
    return _TOUCHING.format(overlap=overlap, minimum=min(lanes.thresholds))


def _fold(groups: DataFrame, lanes: Lanes) -> DataFrame:
    """Rows with ordered ``dets`` (each with ordered ``cands``) and ``gts`` to one row per detection with its masks.

    Rows put aside (see :func:`_staged`) come out as they went in, without masks.
    """
    aside = ["_d AS d", "_g AS g"] if "_solo" in groups.columns else []
    outcome = groups.withColumn("_out", F.expr(_FOLD.format(every=lanes.every)))
    keys = [*GROUP, "_solo", "_d", "_g"] if aside else GROUP
    rows = outcome.selectExpr(*keys, "posexplode(arrays_zip(dets, _out)) AS (rank, _row)")
    beyond = f"(~_row.dets.in_range & ~(_row._out.tp | _row._out.ig) & {lanes.every}L)"
    tp, ignored = "_row._out.tp", f"_row._out.ig | {beyond}"
    if aside:
        tp, ignored = (f"CASE WHEN _solo IS NULL THEN {mask} END" for mask in (tp, ignored))
    names = ["_row.dets.det_idx AS det_idx", "-_row.dets.signed AS score", "rank"]
    return rows.selectExpr(*GROUP, *names, f"{tp} AS tp_mask", f"{ignored} AS ignore_mask", *aside)


def _capped(dets: str, max_dets: int | None) -> str:
    return dets if max_dets is None else f"slice({dets}, 1, {int(max_dets)})"


@dataclass(frozen=True)
class Overlap:
    """How a detection ``d`` and the ground truths ``gts`` of its group overlap, and the columns that takes.

    ``near`` is SQL for an array of (overlap, pos, regular, crowd); ``pairs`` does the same for groups too large to gather,
    as rows (group, det_idx, gt_idx, overlap, regular, crowd).
    """

    near: str
    pairs: Callable[[DataFrame, DataFrame], DataFrame]
    detection: tuple[str, ...] = ("x1", "y1", "x2", "y2")
    truth: tuple[str, ...] = ("x1", "y1", "x2", "y2")


def box_overlap(lanes: Lanes) -> Overlap:
    return Overlap(_touching(lanes), lambda d, g: large_group_pairs(d, g, lanes))


def _fields(names: Sequence[str]) -> str:
    return "".join(f", '{n}', {n}" for n in names)


def _folded(both: DataFrame, limit: int, dets: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Folded detections of the small groups, and the rows (``d``, ``g``) of larger ones, without masks.

    One shuffle counts the rows of each group and gathers the small ones; each row of a larger group is a group of its
    own there (``_solo``) and is put aside. All is to be written at once, so that the inputs are read and computed once.
    """
    sized = both.withColumn("_rows", F.count("*").over(Window.partitionBy(*GROUP)))
    solo = F.when(F.col("_rows") > limit, F.monotonically_increasing_id())
    single = "array(get(collect_list({0}), 0))"
    groups = sized.withColumn("_solo", solo).groupBy(*GROUP, "_solo").agg(
        F.expr(f"CASE WHEN _solo IS NULL THEN {dets} ELSE {single.format('d')} END AS dets"),
        F.expr("array_sort(collect_list(g)) AS gts"),
    )
    groups = groups.filter("size(dets) > 0").selectExpr(
        "*", "CASE WHEN _solo IS NOT NULL THEN get(dets, 0) END AS _d", "CASE WHEN _solo IS NOT NULL THEN get(gts, 0) END AS _g"
    )
    return fold(groups)


def _staged(staged: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Stored rows of :func:`_folded` as those of the small groups, and those of larger ones if there are any."""
    aside = staged.filter("tp_mask IS NULL").select(*GROUP, "d", "g")
    return staged.filter("tp_mask IS NOT NULL").drop("d", "g"), aside if scale.any_rows(aside) else None


def _fold_overlaps(
    detections: DataFrame, ground_truth: DataFrame, overlap: Overlap, lanes: Lanes, max_dets: int | None, limit: int
) -> DataFrame:
    """One shuffle: both sides of a group meet in one row and overlaps are computed there."""
    d = detections.selectExpr(
        *GROUP, f"named_struct('signed', -score, 'det_idx', det_idx{_fields(overlap.detection)}, 'in_range', in_range) AS d"
    )
    g = ground_truth.selectExpr(
        *GROUP, f"named_struct('gt_idx', gt_idx{_fields(overlap.truth)}, 'crowd', crowd, 'regular', regular) AS g"
    )

    both = d.unionByName(g, allowMissingColumns=True)
    dets = _capped("array_sort(collect_list(d))", max_dets)
    rows = _folded(both, limit, dets, lambda groups: _fold_groups(groups, lanes, overlap.near))
    folded, large = _staged(scale.stored(rows, "matched"))
    if large is None:
        return folded
    # Capped before any join: the group limit keeps at most max_dets rows per map task.
    found = large.filter("d IS NOT NULL").select(*GROUP, "d.*").selectExpr("*", "-signed AS score").drop("signed")
    found = scale.stored(rank_detections(found, max_dets), "ranked")
    truth = large.filter("g IS NOT NULL").select(*GROUP, "g.*")
    return folded.unionByName(_settled(found, overlap.pairs(found, truth), lanes))


def _fold_groups(groups: DataFrame, lanes: Lanes, near: str) -> DataFrame:
    """The fold of rows with ordered ``dets`` and ``gts`` that overlap as *near* says."""
    cands = _candidates(near, lanes)
    with_candidates = (
        f"transform(dets, d -> named_struct('signed', d.signed, 'det_idx', d.det_idx, 'in_range', d.in_range, 'cands', {cands}))"
    )
    ready = groups.filter("size(dets) > 0").withColumn("dets", F.expr(with_candidates))
    return _fold(ready, lanes)


def image_groups(images: DataFrame, lanes: Lanes, max_dets: int | None = None) -> DataFrame:
    """(image_id, label, dets, gts) of whole-image rows, without a shuffle; ready for :func:`match_groups`.

    ``gts`` tells by its mask ``regular`` which ground truths count in which lanes.
    """
    labels = "transform(coalesce({0}, array()), e -> e.label)"
    both = f"array_distinct(concat({labels.format('detections')}, {labels.format('ground_truth')}))"
    named = images.selectExpr("image_id", "detections", "ground_truth", f"explode({both}) AS label").filter("label IS NOT NULL")
    corners = "'x1', CAST(e.x1 AS DOUBLE), 'y1', CAST(e.y1 AS DOUBLE), 'x2', CAST(e.x2 AS DOUBLE), 'y2', CAST(e.y2 AS DOUBLE)"
    box_area = "((e.x2 - e.x1) * (e.y2 - e.y1))"
    truth_area = f"(CASE WHEN e.area > 0 THEN e.area ELSE {box_area} END)"
    dets = f"named_struct('signed', -e.score, 'det_idx', e.det_idx, {corners}, 'in_range', {lanes.inside(box_area)})"
    gts = (
        f"named_struct('gt_idx', e.gt_idx, {corners}, 'crowd', coalesce(e.iscrowd, false), "
        f"'regular', CASE WHEN e.iscrowd THEN 0L ELSE {lanes.inside(truth_area)} END)"
    )

    def own(name: str, struct: str) -> str:
        return f"array_sort(transform(filter(coalesce({name}, array()), e -> e.label = label), e -> {struct}))"

    return named.selectExpr(*GROUP, f"{_capped(own('detections', dets), max_dets)} AS dets", f"{own('ground_truth', gts)} AS gts")


def match_groups(groups: DataFrame, lanes: Lanes) -> DataFrame:
    """Masks of every detection of :func:`image_groups`, also on a stream."""
    return _fold_groups(groups, lanes, _touching(lanes))


def _fold_pairs(
    detections: DataFrame, ground_truth: DataFrame, pairs: DataFrame, lanes: Lanes, max_dets: int | None, limit: int, parts: int
) -> DataFrame:
    """The same fold when overlaps were computed elsewhere (masks)."""
    def fold(groups: DataFrame) -> DataFrame:
        located = (
            "filter(transform(d.found, f -> named_struct('overlap', f.overlap, 'pos', CAST(array_position(gts, f.gt_idx) AS INT), "
            "'regular', f.regular, 'crowd', f.crowd)), c -> c.pos > 0)"
        )
        ordered = _capped(
            "array_sort(transform(dets, d -> named_struct('signed', d.signed, 'det_idx', d.det_idx, 'in_range', d.in_range, "
            f"'cands', {_candidates(located, lanes)})))",
            max_dets,
        )
        return _fold(groups.withColumn("dets", F.expr(ordered)), lanes)

    def matched(detections: DataFrame, truth: DataFrame, pairs: DataFrame) -> DataFrame:
        near = pairs.filter(F.col("overlap") >= min(lanes.thresholds)).join(truth, [*GROUP, "gt_idx"])
        by_detection = near.groupBy(*GROUP, "det_idx").agg(
            F.expr("collect_list(named_struct('gt_idx', gt_idx, 'overlap', overlap, 'regular', regular, 'crowd', crowd)) AS found")
        )
        d = detections.join(by_detection, [*GROUP, "det_idx"], "left").selectExpr(
            *GROUP,
            "named_struct('signed', -score, 'det_idx', det_idx, 'in_range', in_range, 'found', coalesce(found, array())) AS d",
        )
        both = d.unionByName(truth.select(*GROUP, F.col("gt_idx").alias("g")), allowMissingColumns=True)
        return _folded(both, limit, "collect_list(d)", fold)

    # Each side is parted on its own: joins pass a filter on to one of their sides only, if others are behind it.
    sides = [detections, ground_truth.select(*GROUP, "gt_idx", "crowd", "regular"), pairs]
    rows = scale.in_parts(parts, "image_id", sides, matched, "matched")
    folded, large = _staged(scale.stored(rows, "matched") if parts == 1 else rows)
    if large is None:
        return folded
    found = large.filter("d IS NOT NULL").select(*GROUP, "d.*").selectExpr("*", "-signed AS score").drop("signed")
    found = scale.stored(rank_detections(found, max_dets), "ranked")
    return folded.unionByName(_settled(found.drop("found"), found.select(*GROUP, "det_idx", F.inline("found")), lanes))


# --- groups too large to gather ---------------------------------------------------------------------------------------


def _grid_pairs(detections: DataFrame, ground_truth: DataFrame, minimum: float, with_truth: Sequence[str]) -> DataFrame:
    """All same-group pairs with IoU >= *minimum* > 0, found by size level and cell instead of all against all.

    Such a pair's widths (and heights) differ by a factor of at most 1/minimum and its centres are close, so a ground
    truth is copied to the few levels and cells where a partner's centre can be. Each detection sits in one cell.
    """
    reach = math.ceil(math.log2(1 / minimum)) if minimum < 1 else 0

    def level(size: Column) -> Column:
        return F.floor(F.log2(size)).cast("int")

    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    d = detections.filter((w > 0) & (h > 0)).withColumns({"_lw": level(w), "_lh": level(h)})
    d = d.withColumns(
        {
            "_cx": F.floor((F.col("x1") + F.col("x2")) / 2 / F.pow(F.lit(2.0), F.col("_lw") + 1)),
            "_cy": F.floor((F.col("y1") + F.col("y2")) / 2 / F.pow(F.lit(2.0), F.col("_lh") + 1)),
        }
    )
    g = ground_truth.filter((w > 0) & (h > 0))
    g = g.withColumn("_lw", F.explode(F.sequence(level(w) - reach, level(w) + reach)))
    g = g.withColumn("_lh", F.explode(F.sequence(level(h) - reach, level(h) + reach)))

    def cells(low: Column, high: Column, level_name: str) -> Column:
        size = high - low
        small = F.pow(F.lit(2.0), F.col(level_name))  # a partner's size is in [small, 2 * small)
        distance = (small * 2 + size) / 2 - F.greatest(small, size) * minimum
        cell = small * 2
        middle = (low + high) / 2
        return F.sequence(F.floor((middle - distance) / cell), F.floor((middle + distance) / cell))

    g = g.withColumn("_cx", F.explode(cells(F.col("x1"), F.col("x2"), "_lw")))
    g = g.withColumn("_cy", F.explode(cells(F.col("y1"), F.col("y2"), "_lh")))
    keys = [*GROUP, "_lw", "_lh", "_cx", "_cy"]
    right = g.select(*keys, "gt_idx", *with_truth, *bx.box().named("gx1", "gy1", "gx2", "gy2"))
    joined = d.join(right, keys)
    overlap = bx.iou(bx.box(), bx.Box(*[F.col(c) for c in ("gx1", "gy1", "gx2", "gy2")]))
    return joined.withColumn("overlap", overlap).filter(F.col("overlap") >= minimum).select(
        *GROUP, "det_idx", "gt_idx", "overlap", *with_truth
    )


def _crowd_coverage_pairs(detections: DataFrame, crowds: DataFrame, minimum: float) -> DataFrame:
    """Pairs whose intersection covers at least *minimum* of the detection, by a grid over the crowd boxes.

    The detection's box must touch the crowd box; its corner-side cells at each crowd size level present in its group
    are looked up. A crowd box is at most one cell wide at its own level, so it fills at most four cells.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    boxes = crowds.filter((w > 0) & (h > 0)).groupBy(*GROUP, "x1", "y1", "x2", "y2").agg(F.max("gt_idx").alias("gt_idx"))
    level = F.ceil(F.log2(F.greatest(w, h))).cast("int")
    boxes = boxes.withColumn("_level", level).withColumn("_cell", F.pow(F.lit(2.0), F.col("_level")))

    def span(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / F.col("_cell")), F.floor(high / F.col("_cell")))

    placed = boxes.withColumn("_cx", F.explode(span(F.col("x1"), F.col("x2"))))
    placed = placed.withColumn("_cy", F.explode(span(F.col("y1"), F.col("y2"))))
    levels = boxes.select(*GROUP, "_level", "_cell").distinct()
    # A crowd covering enough of a detection is at least minimum times as wide and high, so smaller levels are skipped
    # and a detection touches at most 1 / minimum + 2 cells per axis.
    found = detections.filter((w > 0) & (h > 0)).join(levels, GROUP)
    found = found.filter(F.col("_cell") >= F.greatest(w, h) * minimum)
    found = found.withColumn("_cx", F.explode(span(F.col("x1"), F.col("x2"))))
    found = found.withColumn("_cy", F.explode(span(F.col("y1"), F.col("y2"))))
    keys = [*GROUP, "_level", "_cx", "_cy"]
    right = placed.select(*keys, "gt_idx", *bx.box().named("gx1", "gy1", "gx2", "gy2"))
    joined = found.join(right, keys)
    region = bx.Box(*[F.col(c) for c in ("gx1", "gy1", "gx2", "gy2")])
    # Report a pair once: in the cell of the intersection's low corner.
    own_cell = (F.floor(F.greatest(F.col("x1"), region.x1) / F.col("_cell")) == F.col("_cx")) & (
        F.floor(F.greatest(F.col("y1"), region.y1) / F.col("_cell")) == F.col("_cy")
    )
    pairs = joined.filter(own_cell).withColumn("overlap", bx.coverage(bx.box(), region))
    return pairs.filter(F.col("overlap") >= minimum).select(*GROUP, "det_idx", "gt_idx", "overlap")


def _best_crowd(pairs: DataFrame, lanes: Lanes) -> DataFrame:
    """A crowd serves any number of detections, so only the one a detection would pick matters."""
    tie = F.col("gt_idx") if lanes.later_wins else -F.col("gt_idx")
    best = F.max(F.struct(F.col("overlap"), tie.alias("tie"), F.col("gt_idx"))).alias("_best")
    return pairs.groupBy(*GROUP, "det_idx").agg(best).select(
        *GROUP, "det_idx", F.col("_best.gt_idx").alias("gt_idx"), F.col("_best.overlap").alias("overlap")
    )


def large_group_pairs(detections: DataFrame, ground_truth: DataFrame, lanes: Lanes) -> DataFrame:
    """Candidate pairs of large groups: overlap, regular-lane mask and crowd flag."""
    minimum = min(lanes.thresholds)
    regular = _grid_pairs(detections, ground_truth.filter(~F.col("crowd")), minimum, ["regular"])
    crowds = ground_truth.filter(F.col("crowd"))
    if lanes.crowd_rule == "iou":
        crowd_pairs = _grid_pairs(detections, crowds, minimum, [])
    else:
        crowd_pairs = _crowd_coverage_pairs(detections, crowds, minimum)
    crowd_pairs = _best_crowd(crowd_pairs, lanes)
    return regular.withColumn("crowd", F.lit(False)).unionByName(
        crowd_pairs.withColumns({"regular": F.lit(0).cast("long"), "crowd": F.lit(True)})
    )


_WISH = [*GROUP, "lane", "det_idx"]


def _wishes(detections: DataFrame, pairs: DataFrame, lanes: Lanes) -> DataFrame:
    """One row for each pair and lane it may serve: who wishes (``rank``), what (``wish``, smallest first), for whom."""
    reach = lanes.reached("overlap")
    masks = pairs.selectExpr("*", f"{reach} & regular AS _regular", f"{reach} & ~regular AS _ignored")
    lane_numbers = F.array(*[F.lit(i) for i in range(len(lanes))])
    lane_rows = masks.withColumn(
        "lane",
        F.explode(F.filter(lane_numbers, lambda i: F.getbit(F.col("_regular").bitwiseOR(F.col("_ignored")), i) == 1)),
    )
    ignored = F.getbit(F.col("_ignored"), F.col("lane")) == 1
    tie = -F.col("gt_idx") if lanes.later_wins else F.col("gt_idx")
    ranked = detections.select(*GROUP, "det_idx", "rank")
    return lane_rows.join(ranked, [*GROUP, "det_idx"]).select(
        *_WISH,
        "rank",
        F.struct(
            ignored.alias("ignored"), (-F.col("overlap")).alias("signed"), tie.alias("tie"), F.col("gt_idx"), F.col("crowd")
        ).alias("wish"),
    )


def _settle_in_turn(key: tuple[pa.Scalar, ...], wishes: pa.Table) -> pa.Table:
    """The wishes of one lane of a group, by rank: each detection gets its best ground truth that is still free."""
    flat = wishes.select(["det_idx", "rank"])
    for name, column in zip(("ignored", "signed", "tie", "gt_idx", "crowd"), wishes["wish"].combine_chunks().flatten(), strict=True):
        flat = flat.append_column(name, column)
    flat = flat.sort_by([(c, "ascending") for c in ("rank", "ignored", "signed", "tie")])
    taken, served, ignored = set(), [], []
    last = None
    for det, truth, crowd, ignore in zip(*(flat[c].to_pylist() for c in ("det_idx", "gt_idx", "crowd", "ignored")), strict=True):
        if det == last or (truth in taken and not crowd):
            continue
        last = det
        served.append(det)
        ignored.append(ignore)
        if not crowd:
            taken.add(truth)
    same = [pa.array([k.as_py()] * len(served), k.type) for k in key]
    columns = [*same, pa.array(served, pa.int64()), pa.array(ignored, pa.bool_())]
    return pa.table(columns, [*GROUP, "lane", "det_idx", "ignored"])


def _round(wishes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled detections, wishes still open). At least the best-ranked detection of every lane is settled."""
    best = wishes.groupBy(*_WISH).agg(F.min("wish").alias("wish"), F.min("rank").alias("rank"))
    best = best.withColumns({"gt_idx": F.col("wish.gt_idx"), "crowd": F.col("wish.crowd")})
    truth = [*GROUP, "lane", "gt_idx"]
    wanted = wishes.filter("NOT wish.crowd").select(*truth[:-1], F.col("wish.gt_idx").alias("gt_idx"), "rank", F.lit(False).alias("asks"))
    asked = best.filter("NOT crowd").select(*truth, "rank", F.lit(True).alias("asks"))
    # Of each ground truth: its best-ranked wisher, and the best-ranked of those who wish for nothing more.
    heads = wanted.unionAll(asked).groupBy(*truth).agg(F.min("rank").alias("first"), F.min(F.when(F.col("asks"), F.col("rank"))).alias("holder"))
    heads = scale.stored(heads, "wish-heads")
    settled = best.join(heads, truth, "left").filter(F.col("crowd") | (F.col("rank") == F.col("first")))
    settled = scale.stored(settled.select(*_WISH, F.col("wish.ignored").alias("ignored")), "settled")
    # Gone: wishes of settled detections, and those for a ground truth that a better-ranked detection asks for.
    left = wishes.join(settled.select(*_WISH), _WISH, "left_anti").withColumn("gt_idx", F.col("wish.gt_idx"))
    left = left.join(heads.select(*truth, "holder"), truth, "left")
    still = F.col("wish.crowd") | F.col("holder").isNull() | (F.col("rank") <= F.col("holder"))
    return settled, left.filter(still).select(*wishes.columns)


def _settled(detections: DataFrame, pairs: DataFrame, lanes: Lanes, in_turn: int | None = None) -> DataFrame:
    """Masks of ranked *detections* from their candidate pairs. Lanes of at most *in_turn* wishes are settled in a task."""
    in_turn = IN_TURN if in_turn is None else in_turn
    wishes = scale.stored(_wishes(detections, pairs, lanes), "wishes")
    kinds = [f"{name} {wishes.schema[name].dataType.simpleString()}" for name in GROUP]
    schema = f"{', '.join(kinds)}, lane int, det_idx bigint, ignored boolean"
    parts = []
    while scale.any_rows(wishes):
        lane = [*GROUP, "lane"]
        large = scale.stored(wishes.groupBy(*lane).count().filter(F.col("count") > in_turn).select(*lane), "large-lanes")
        few = wishes.join(large, lane, "left_anti")
        parts.append(scale.stored(few.groupBy(*lane).applyInArrow(_settle_in_turn, schema), "settled"))
        if not scale.any_rows(large):
            break
        settled, left = _round(wishes.join(large, lane, "left_semi"))
        parts.append(settled)
        left = scale.stored(left, "wishes")
        scale.discard(wishes)
        wishes = left
    scale.discard(wishes)
    zero = F.lit(0).cast("long")
    rows = reduce(DataFrame.unionByName, parts) if parts else detections.sparkSession.createDataFrame([], schema)
    bit = "shiftleft(CAST(1 AS BIGINT), lane)"
    chosen = rows.groupBy(*GROUP, "det_idx").agg(
        F.expr(f"bit_or(CASE WHEN ignored THEN 0L ELSE {bit} END) AS tp"),
        F.expr(f"bit_or(CASE WHEN ignored THEN {bit} ELSE 0L END) AS ig"),
    )
    joined = detections.join(chosen, [*GROUP, "det_idx"], "left")
    tp, ig = F.coalesce("tp", zero), F.coalesce("ig", zero)
    beyond = F.bitwise_not(F.col("in_range")).bitwiseAND(F.bitwise_not(tp.bitwiseOR(ig)))
    return joined.select(
        *GROUP,
        "det_idx",
        "score",
        "rank",
        tp.alias("tp_mask"),
        ig.bitwiseOR(beyond.bitwiseAND(F.lit(lanes.every))).alias("ignore_mask"),
    )


# --- public ----------------------------------------------------------------------------------------------------------


def match_lanes(
    detections: DataFrame,
    ground_truth: DataFrame,
    lanes: Lanes,
    pairs: DataFrame | None = None,
    max_dets: int | None = None,
    group_row_limit: int = scale.GROUP_ROW_LIMIT,
    overlap: Overlap | None = None,
    parts: int = 1,
) -> DataFrame:
    """Every detection with its rank in image and class, and ``tp_mask`` and ``ignore_mask`` over *lanes*.

    Boxes overlap unless *overlap* says how else, or *pairs* (image_id, label, det_idx, gt_idx, overlap) were computed
    elsewhere; these may be matched in *parts* (see :func:`gridmark.scale.in_parts`). *max_dets* is the protocol's cap per
    image and class, taken in rank order before matching. The result is a stored table.
    """
    overlap = overlap or box_overlap(lanes)
    d = _detection_columns(detections, lanes, overlap.detection if pairs is None else ())
    g = _truth_columns(ground_truth, lanes, overlap.truth if pairs is None else ())
    if pairs is None:
        return _fold_overlaps(d, g, overlap, lanes, max_dets, group_row_limit)
    return _fold_pairs(d, g, pairs, lanes, max_dets, group_row_limit, parts)


def match_greedy(
    detections: DataFrame,
    ground_truth: DataFrame,
    iou_threshold: float = 0.5,
    pairs: DataFrame | None = None,
    group_row_limit: int = scale.GROUP_ROW_LIMIT,
) -> DataFrame:
    """Confidence-sweep matching: each detection is a true positive, ignored (on a crowd) or a false positive.

    Detections are ranked at full precision; the reported score is FLOAT, as the sweep consumes it.
    """
    matched = match_lanes(detections, ground_truth, Lanes((iou_threshold,)), pairs, group_row_limit=group_row_limit)
    return matched.select(
        *GROUP,
        "det_idx",
        F.col("score").cast("float").alias("score"),
        (F.col("tp_mask") != 0).alias("is_tp"),
        (F.col("ignore_mask") != 0).alias("is_ignored"),
    )


def ground_truth_counts(ground_truth: DataFrame, *seen: DataFrame) -> DataFrame:
    """Non-crowd ground truths per class, with a zero row for classes only seen in *seen*."""
    counted = ground_truth.select("label", F.when(F.col("iscrowd"), 0).otherwise(1).alias("n"))
    for frame in seen:
        counted = counted.unionAll(frame.select("label", F.lit(0).alias("n")))
    return counted.groupBy("label").agg(F.sum("n").alias("total_gt"))


def merge_matched(*parts: DataFrame) -> DataFrame:
    """Matched rows of several batches or workers form one table; aggregation stays Spark's."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged
