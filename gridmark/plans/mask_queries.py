"""Masks as column-major runs: overlap, extent, run lengths and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmark import scale
from gridmark.operators import average_precision as ap
from gridmark.operators import labels as lb
from gridmark.operators import masks as mk
from gridmark.operators import matching as mt
from gridmark.plans.fixtures import view, with_views
from gridmark.plans.precision_queries import STATISTICS, protocol_sql
from gridmark.plans.registry import query
from gridmark.sources import coco

# Boxes as masks at full size on a grid of 100 rows and 110 columns: a run of pixels for each column.
_HEIGHT, _WIDTH = 100, 110


def _heights():
    """Images of different heights; pixels are only compared within an image."""
    return F.col("image_id") % 37 + _HEIGHT


_RECTS = """
    dm as (select image_id, label, det_idx as instance_id, floor(x1)::bigint as x1, floor(y1)::bigint as y1,
             floor(x2)::bigint as x2, floor(y2)::bigint as y2 from det),
    gm as (select image_id, label, gt_idx as instance_id, floor(x1)::bigint as x1, floor(y1)::bigint as y1,
             floor(x2)::bigint as x2, floor(y2)::bigint as y2, iscrowd from gt),
    mask_pairs as (select d.image_id, d.label, d.instance_id as left_id, g.instance_id as right_id, g.iscrowd,
             greatest(least(d.x2,g.x2)-greatest(d.x1,g.x1),0)*greatest(least(d.y2,g.y2)-greatest(d.y1,g.y1),0) as intersection,
             (d.x2-d.x1)*(d.y2-d.y1) + (g.x2-g.x1)*(g.y2-g.y1) as both_areas
           from dm d join gm g using (image_id, label))
"""


def _rectangles(rows, key):
    cells = [F.floor(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return rows.select("image_id", "label", F.col(key).alias("instance_id"), *cells)


def _base(spark, folder):
    """Numbered rows as a stored table, so that they are numbered once and can be read image by image."""
    return scale.stored(view(spark, folder, "base"), "base")


def _runs(spark, folder, name, key, packed=False):
    return mk.rectangle_runs(_rectangles(view(spark, folder, name), key), F.lit(_HEIGHT), packed)


def _masks(spark, folder, name, key, **tables):
    return mk.rectangle_masks(_rectangles(view(spark, folder, name, **tables), key), _heights())


@query("mask_overlaps", with_views(
    f"""with {_RECTS} select image_id, label, left_id, right_id, intersection, both_areas - intersection as "union",
          intersection::double / (both_areas - intersection) as iou from mask_pairs where intersection > 0""",
    "det", "gt"))
def mask_overlaps(spark, folder):
    rows = mk.mask_overlaps(_masks(spark, folder, "det", "det_idx"), _masks(spark, folder, "gt", "gt_idx"))
    return rows.select("image_id", "label", "left_id", "right_id", "intersection", "union", "iou")


# Steps: the left third of a box at full height, the middle third from its half down, the rest not at all.
_STEPS = """
    dsteps as (select image_id, label, instance_id, x1 + k * ((x2-x1)//3) as x1, x1 + (k+1) * ((x2-x1)//3) as x2,
                 case when k = 0 then y1 else y1 + (y2-y1)//2 end as y1, y2 from dm cross join (select unnest([0, 1]) as k)),
    gsteps as (select image_id, label, instance_id, x1 + k * ((x2-x1)//3) as x1, x1 + (k+1) * ((x2-x1)//3) as x2,
                 case when k = 0 then y1 else y1 + (y2-y1)//2 end as y1, y2 from gm cross join (select unnest([0, 1]) as k)),
    darea as (select image_id, label, instance_id, sum((x2-x1)*(y2-y1))::bigint as area from dsteps group by all),
    garea as (select image_id, label, instance_id, sum((x2-x1)*(y2-y1))::bigint as area from gsteps group by all),
    shared as (select d.image_id, d.label, d.instance_id as left_id, g.instance_id as right_id,
                 sum(greatest(least(d.x2,g.x2)-greatest(d.x1,g.x1),0)*greatest(least(d.y2,g.y2)-greatest(d.y1,g.y1),0))::bigint
                   as intersection from dsteps d join gsteps g using (image_id, label) group by all)
"""


@query("stepped_mask_overlaps", with_views(
    f"""with {_RECTS}, {_STEPS} select s.image_id, s.label, left_id, right_id, intersection, d.area + g.area - intersection as "union"
        from shared s join darea d on d.image_id = s.image_id and d.label = s.label and d.instance_id = left_id
        join garea g on g.image_id = s.image_id and g.label = s.label and g.instance_id = right_id where intersection > 0""",
    "det", "gt"))
def stepped_mask_overlaps(spark, folder):
    """Masks that are no rectangles, packed from their runs."""
    base = _base(spark, folder)

    def side(name, key):
        r, third = _rectangles(view(spark, folder, name, base=base), key), F.expr("(x2 - x1) div 3")
        parts = r.withColumns({"_third": third, "_k": F.explode(F.array(F.lit(0), F.lit(1)))})
        steps = parts.withColumns({
            "x2": F.col("x1") + (F.col("_k") + 1) * F.col("_third"), "x1": F.col("x1") + F.col("_k") * F.col("_third"),
            "y1": F.when(F.col("_k") == 0, F.col("y1")).otherwise(F.col("y1") + F.expr("(y2 - y1) div 2")),
        })
        runs = mk.rectangle_runs(steps, _heights(), packed=True)
        return mk.pack_masks(runs, _heights())

    rows = mk.mask_overlaps(side("det", "det_idx"), side("gt", "gt_idx"), parts=scale.part_count(base))
    return rows.select("image_id", "label", "left_id", "right_id", "intersection", "union")


_WALK = """
    pairs as (select image_id, label, left_id as det_idx, right_id as gt_idx, iscrowd,
                intersection::double / (both_areas - intersection) as iou from mask_pairs),
    cand as (select image_id, label, det_idx,
               list(gt_idx order by iou desc, gt_idx) filter (not iscrowd and iou >= 0.5) as open,
               bool_or(iscrowd and iou >= 0.5) as on_crowd from pairs group by all),
    ranked as (select d.image_id, d.label, d.det_idx, c.open, coalesce(c.on_crowd, false) as on_crowd,
                 row_number() over (partition by d.image_id, d.label order by d.score desc, d.det_idx) as rk
               from det d left join cand c using (image_id, label, det_idx)),
    walk as (
      select image_id, label, 0::bigint as rk, []::bigint[] as used, 0::bigint as det_idx, false as is_tp, false as is_ignored
      from (select distinct image_id, label from det)
      union all
      select image_id, label, rk, case when pick is null then used else list_append(used, pick) end, det_idx,
             pick is not null, pick is null and on_crowd
      from (select r.image_id, r.label, r.rk, w.used, r.det_idx, r.on_crowd,
                   list_filter(r.open, lambda x: not list_contains(w.used, x))[1] as pick
            from walk w join ranked r on r.image_id = w.image_id and r.label = w.label and r.rk = w.rk + 1))
"""


@query("mask_matching", with_views(
    f"with recursive {_RECTS}, {_WALK} select image_id, label, det_idx, is_tp, is_ignored from walk where rk > 0",
    "det", "gt", recursive=True))
def mask_matching(spark, folder):
    pairs = mk.matching_pairs(_masks(spark, folder, "det", "det_idx"), _masks(spark, folder, "gt", "gt_idx"))
    rows = mt.match_greedy(view(spark, folder, "det"), view(spark, folder, "gt"), pairs=pairs)
    return rows.select("image_id", "label", "det_idx", "is_tp", "is_ignored")


@query("mask_boxes", with_views(
    f"""with {_RECTS} select image_id, label, instance_id, x1::double as x1, y1::double as y1, (x2-1)::double as x2,
          (y2-1)::double as y2, x2::double as end_x, y2::double as end_y from dm""", "det", "gt"))  # fmt: skip
def mask_boxes(spark, folder):
    runs = _runs(spark, folder, "det", "det_idx")
    keys = ["image_id", "label", "instance_id"]
    inclusive = mk.tight_boxes(runs, F.lit(_HEIGHT), exclusive_end=False)
    exclusive = mk.tight_boxes(runs, F.lit(_HEIGHT), exclusive_end=True)
    return inclusive.join(exclusive.select(*keys, F.col("x2").alias("end_x"), F.col("y2").alias("end_y")), keys)


@query("boxes_follow_masks", with_views(
    f"""with {_RECTS}, moved as (select *, greatest(x1-3, 0) as nx1, greatest(x2-3, 0) as nx2, instance_id % 5 <> 4 as had from dm)
        select image_id, label, instance_id,
          case when had then nx1::double else -1::double end as x1, case when had then y1::double else -1::double end as y1,
          case when had then nx2::double else -1::double end as x2, case when had then y2::double else -1::double end as y2
        from moved where not had or nx2 > nx1""", "det", "gt"))  # fmt: skip
def boxes_follow_masks(spark, folder):
    """Masks move three columns left; instances 4, 9 ... of an image have a box only."""
    rectangles = _rectangles(view(spark, folder, "det"), "det_idx")
    masked = rectangles.filter(F.col("instance_id") % 5 != 4)
    moved = masked.withColumns({c: F.greatest(F.col(c) - 3, F.lit(0)) for c in ("x1", "x2")})
    boxes = rectangles.withColumns({c: F.lit(-1.0) for c in ("x1", "y1", "x2", "y2")})
    before, after = (mk.rectangle_runs(r, F.lit(_HEIGHT)) for r in (masked, moved))
    return mk.sync_boxes(boxes, before, after, F.lit(_HEIGHT)).select("image_id", "label", "instance_id", "x1", "y1", "x2", "y2")


@query("mask_run_lengths", with_views(
    f"""with {_RECTS},
    cols as (select image_id, label, instance_id, x2 - x1 as n, x1, y1, y2, unnest(generate_series(0, x2 - x1 - 1)) as c from dm),
    steps as (
      select image_id, label, instance_id, (2*c)::int as position,
        case when c = 0 then x1*100 + y1 else 100 - (y2 - y1) end as length from cols
      union all select image_id, label, instance_id, (2*c + 1)::int, y2 - y1 from cols
      union all select image_id, label, instance_id, (2*n)::int, 11000 - ((x1 + n - 1)*100 + y2) from cols
        where c = n - 1 and 11000 > (x1 + n - 1)*100 + y2)
    select * from steps""", "det", "gt"))  # fmt: skip
def mask_run_lengths(spark, folder):
    rows = mk.run_lengths(_runs(spark, folder, "det", "det_idx", packed=True), F.lit(_WIDTH * _HEIGHT))
    return rows.select("image_id", "label", "instance_id", "position", "length")


@query("polygon_runs", with_views(
    f"""with {_RECTS}, cols as (select image_id, label, instance_id, y1, y2, unnest(generate_series(x1, x2 - 1)) as c from gm)
        select image_id, label, instance_id, c*100 + y1 as run_start, c*100 + y2 as run_end from cols""", "det", "gt"))  # fmt: skip
def polygon_runs(spark, folder):
    """Rectangles given as polygons fill the same pixels."""
    r = _rectangles(view(spark, folder, "gt"), "gt_idx")
    corners = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")])
    instances = r.select(
        "image_id", "label", "instance_id", F.lit(_HEIGHT).alias("height"), F.lit(_WIDTH).alias("width"),
        F.array(corners, F.slice(corners, 1, 4)).alias("polygons"),
    )
    return mk.polygon_runs(instances)


_INTER = "(greatest(least(d.x2,g.x2)-greatest(d.x1,g.x1),0)*greatest(least(d.y2,g.y2)-greatest(d.y1,g.y1),0))"
_PIXELS = "floor(x1) as x1, floor(y1) as y1, floor(x2) as x2, floor(y2) as y2, (floor(x2)-floor(x1))*(floor(y2)-floor(y1))"
_MASK_PROTOCOL = protocol_sql(
    f"""select d.image_id, d.label, d.det_idx, g.gt_idx, g.crowd, g.garea,
          case when g.crowd then {_INTER} / d.area else {_INTER} / (d.area + g.garea - {_INTER}) end as overlap
        from found d join truth g using (image_id, label)""",
    f"select image_id, label, gt_idx, iscrowd as crowd, {_PIXELS} as garea from gt",
    f"select image_id, label, det_idx, score, {_PIXELS} as area from det",
    100,
)


def _mask_evaluation(spark, folder):
    base = _base(spark, folder)
    parts = scale.part_count(base)
    detections, truth = view(spark, folder, "det", base=base), view(spark, folder, "gt", base=base)
    found, real = (_masks(spark, folder, name, key, base=base) for name, key in (("det", "det_idx"), ("gt", "gt_idx")))
    keys, crowds = ["image_id", "label"], truth.filter("iscrowd")
    areas = [mk.mask_areas(masks).withColumnRenamed("instance_id", key) for masks, key in ((found, "det_idx"), (real, "gt_idx"))]
    detections = detections.join(areas[0], [*keys, "det_idx"])
    truth = truth.join(areas[1].withColumnRenamed("area", "mask_area"), [*keys, "gt_idx"], "left")
    pairs = mk.matching_pairs(found, real, crowds, parts=parts)
    return ap.evaluate(detections, truth, pairs=pairs, parts=parts)


@query("mask_statistics", with_views(
    f"with recursive {_MASK_PROTOCOL}, {STATISTICS} select statistic, round(value, 9) as value from stats",
    "det", "gt", recursive=True))
def mask_statistics(spark, folder):
    """The 12 statistics on mask overlaps and mask areas."""
    return ap.summarize_boxes(_mask_evaluation(spark, folder)).withColumn("value", F.round("value", 9))


@query("mask_records", with_views(
    f"""with {_RECTS} select image_id, label * 3 + 1 as category_id, score, 100 as height, 110 as width,
          (2 * (x2 - x1) + 1)::int as counts, x1 * 100 + y1 as first, 11000 - ((x2 - 1) * 100 + y2) as last, 11000::bigint as total
        from dm join (select image_id, label, det_idx as instance_id, score from det) s using (image_id, label, instance_id)
        where label <> 2""", "det", "gt"))  # fmt: skip
def mask_records(spark, folder):
    """Masks as uncompressed run lengths, written as result records and read back."""
    lengths = mk.run_lengths(_runs(spark, folder, "det", "det_idx", packed=True), F.lit(_WIDTH * _HEIGHT), listed=True)
    categories = view(spark, folder, "cat").filter("category_id < 7")
    detections = view(spark, folder, "det").withColumns({"height": F.lit(_HEIGHT), "width": F.lit(_WIDTH)})
    path = scale.run_folder(spark, "mask-records")
    coco.write_records(coco.mask_records(detections, lengths, categories, lb.label_space(view(spark, folder, "cat"))), path, "gzip")
    kind = "image_id bigint, category_id bigint, segmentation struct<size: array<int>, counts: array<bigint>>, score double"
    rows, counts = spark.read.schema(kind).json(path), F.col("segmentation.counts")
    return rows.select(
        "image_id", "category_id", "score", F.get("segmentation.size", 0).alias("height"), F.get("segmentation.size", 1).alias("width"),
        F.size(counts).alias("counts"), F.get(counts, 0).alias("first"), F.element_at(counts, -1).alias("last"),
        F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
    )


@query("mask_records_rebuilt", with_views(
    f"""with {_RECTS}, cols as (select image_id, label, instance_id, x1*100 + y1 + unnest(generate_series(0, x2 - x1 - 1))*100 as s, y2 - y1 as n
          from dm where label <> 2)
        select image_id, label * 3 + 1 as category_id, det_idx, count(*) as runs, sum(n)::bigint as area, min(s)::bigint as first,
          max(s + n)::bigint as last, sum(s * 3 + n)::bigint as digest
        from cols join (select image_id, label, det_idx from det) d on d.image_id = cols.image_id and d.label = cols.label
          and d.det_idx = cols.instance_id group by all""".replace("select image_id, label * 3", "select cols.image_id, cols.label * 3"),
    "det", "gt"))
def mask_records_rebuilt(spark, folder):
    """Masks written as run lengths in JSON, read back as text and rebuilt as runs."""
    lengths = mk.run_lengths(_runs(spark, folder, "det", "det_idx", packed=True), F.lit(_WIDTH * _HEIGHT), listed=True)
    categories = view(spark, folder, "cat").filter("category_id < 7")
    # The score of these records is the detection's number, so each can be told apart.
    detections = view(spark, folder, "det").withColumns(
        {"height": F.lit(_HEIGHT), "width": F.lit(_WIDTH), "score": F.col("det_idx").cast("double")}
    )
    path = scale.run_folder(spark, "mask-records")
    coco.write_records(coco.mask_records(detections, lengths, categories, lb.label_space(view(spark, folder, "cat"))), path, "gzip")
    kind = "image_id bigint, category_id bigint, segmentation string, score double"
    rows = spark.read.schema(kind).json(path).withColumnsRenamed({"category_id": "label"})
    found = mk.read_run_lengths(rows.withColumn("instance_id", F.col("score").cast("bigint"))).filter("reason IS NULL")
    runs = mk.counted_runs(found)
    size = F.col("run_end") - F.col("run_start")
    return runs.groupBy("image_id", F.col("label").alias("category_id"), F.col("instance_id").alias("det_idx")).agg(
        F.count("*").alias("runs"), F.sum(size).alias("area"), F.min("run_start").alias("first"), F.max("run_end").alias("last"),
        F.sum(F.col("run_start") * 3 + size).alias("digest"),
    )
