"""Annotation cleaning, label spaces, validation and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmark.functions import boxes as bx
from gridmark.functions import points as pt
from gridmark.operators import annotations as an
from gridmark.operators import labels as lb
from gridmark.operators import transforms as tr
from gridmark.plans.fixtures import read, view, with_views
from gridmark.plans.registry import query


@query(
    "box_conversions",
    with_views(
        """
        select image_id, gt_idx, (x1+x2)/2 as cx, (y1+y2)/2 as cy, x2-x1 as w, y2-y1 as h,
               (x1+x2)/2 - greatest(x2-x1-45, 0)*0.5::double as rx1, (y1+y2)/2 - greatest(y2-y1-45, 0)*0.5::double as ry1,
               (x1+x2)/2 + greatest(x2-x1-45, 0)*0.5::double as rx2, (y1+y2)/2 + greatest(y2-y1-45, 0)*0.5::double as ry2
        from gt""",
        "gt",
    ),
)
def box_conversions(spark, folder):
    cx, cy, w, h = bx.xyxy_to_cxcywh(bx.box())
    # Sizes are reduced by 45 so some are negative and count as zero.
    back = bx.cxcywh_to_xyxy(cx, cy, w - 45.0, h - 45.0)
    return view(spark, folder, "gt").select(
        "image_id", "gt_idx", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"),
        *back.named("rx1", "ry1", "rx2", "ry2"),
    )


@query(
    "clean_annotated_targets",
    with_views(
        """
        select ann_id, image_id, category_id, area, x1, y1, x2, y2 from (
          select a.ann_id, a.image_id, a.category_id, a.area,
                 least(greatest(x, 0), width::double) as x1, least(greatest(y, 0), height::double) as y1,
                 least(greatest(x+w, 0), width::double) as x2, least(greatest(y+h, 0), height::double) as y2
          from ann a join img i using (image_id) where not iscrowd)
        where x2 > x1 and y2 > y1""",
        "ann",
        "img",
    ),
)
def clean_annotated_targets(spark, folder):
    cleaned = an.clean_annotated(view(spark, folder, "ann"), view(spark, folder, "img"))
    return cleaned.select("ann_id", "image_id", "category_id", "area", "x1", "y1", "x2", "y2")


@query(
    "clean_labelled_targets",
    with_views(
        """
        select ann_id, image_id, (x2-x1)*(y2-y1) as area, false as iscrowd, x1, y1, x2, y2 from (
          select a.ann_id, a.image_id,
                 least(greatest(x, 0), width::double) as x1, least(greatest(y, 0), height::double) as y1,
                 least(greatest(x+w, 0), width::double) as x2, least(greatest(y+h, 0), height::double) as y2
          from ann a join img i using (image_id))
        where x2 > x1 and y2 > y1""",
        "ann",
        "img",
    ),
)
def clean_labelled_targets(spark, folder):
    corners = bx.xywh_to_xyxy(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    boxes = view(spark, folder, "ann").select("ann_id", "image_id", *corners.named())
    cleaned = an.clean_labelled(boxes, view(spark, folder, "img"))
    return cleaned.select("ann_id", "image_id", "area", "iscrowd", "x1", "y1", "x2", "y2")


# Every customer and supplier annotates a category: that of a nation near its own.
_USED = """
    used as (select distinct (c_nationkey - c_nationkey % 5) * 3 + 7 as category_id from customer
             union select distinct (s_nationkey - s_nationkey % 7) * 3 + 10 from supplier),
    kept as (select c.* from cat c where not (
               c.name in (select supercategory from cat
                          where supercategory not in ('', 'none', 'null') and supercategory <> name)
               and c.category_id not in (select category_id from used))),
    space as (select category_id, cast(row_number() over (order by category_id) - 1 as bigint) as label from kept)
"""


def _used_categories(spark, folder):
    customers = read(spark, folder, "customer").select(((F.col("c_nationkey") - F.col("c_nationkey") % 5) * 3 + 7).alias("n"))
    suppliers = read(spark, folder, "supplier").select(((F.col("s_nationkey") - F.col("s_nationkey") % 7) * 3 + 10).alias("n"))
    return customers.unionAll(suppliers).select(F.col("n").cast("long").alias("category_id"))


def _kept(spark, folder):
    return lb.drop_parent_categories(view(spark, folder, "cat"), _used_categories(spark, folder))


@query("drop_parent_categories", with_views(f"with {_USED} select category_id, name, supercategory from kept", "cat"))
def drop_parent_categories(spark, folder):
    return _kept(spark, folder)


@query("label_space", with_views(f"with {_USED} select category_id, label from space", "cat"))
def label_space(spark, folder):
    return lb.label_space(_kept(spark, folder))


@query(
    "names_by_label",
    with_views(
        """select label, coalesce(name, '') as name
           from (select unnest(generate_series(0, (select max(category_id) from cat))) as label)
           left join (select category_id as label, name from cat) using (label)""",
        "cat",
    ),
)
def names_by_label(spark, folder):
    return lb.names_by_label(view(spark, folder, "cat"))


@query(
    "annotated_category_ids",
    with_views(f"with {_USED} select cast(category_id as bigint) as category_id from used", "cat"),
)
def annotated_category_ids(spark, folder):
    return lb.annotated_category_ids(_used_categories(spark, folder))


@query(
    "categories_to_labels",
    with_views(
        f"""with {_USED} select a.ann_id, a.category_id, s.label, case when s.label is null
            then 'unknown category_id' end as reason from ann a left join space s using (category_id)""",
        "cat",
        "ann",
    ),
)
def categories_to_labels(spark, folder):
    good, bad = lb.to_labels(view(spark, folder, "ann"), lb.label_space(_kept(spark, folder)))
    columns = ["ann_id", "category_id", "label", "reason"]
    return good.withColumn("reason", F.lit(None).cast("string")).select(*columns).unionByName(
        bad.withColumn("label", F.lit(None).cast("long")).select(*columns)
    )


@query(
    "keypoint_slots",
    with_views(
        """with bearing as (select category_id, category_id % 24 = 13 as points from cat),
        ranked as (select category_id, points, row_number() over (partition by points order by category_id) - 1 as r
                   from bearing),
        n as (select greatest(count(*), 6) as slots, count(*) filter (points) as k from bearing),
        active as (select unnest([1, 3, 5]) as slot, unnest([0, 1, 2]) as r),
        free as (select s as slot, row_number() over (order by s) - 1 as r
                 from (select unnest(generate_series(0, (select slots - 1 from n))) as s)
                 where s not in (select slot from active where r < (select k from n)))
        select category_id, cast(coalesce(a.slot, f.slot) as bigint) as slot, cast(null as varchar) as problem
        from ranked x left join active a on x.points and a.r = x.r left join free f on not x.points and f.r = x.r""",
        "cat",
    ),
)
def keypoint_slots(spark, folder):
    categories = view(spark, folder, "cat").withColumn(
        "keypoints", F.when(F.col("category_id") % 24 == 13, F.array(F.lit("nose"), F.lit("tail")))
    )
    annotations = view(spark, folder, "ann").select(
        "category_id", F.array().cast("array<double>").alias("keypoints"), F.lit(None).cast("int").alias("num_keypoints")
    )
    return lb.keypoint_slots(categories, annotations, [0, 2, 0, 2, 0, 3])


@query(
    "orphan_annotations",
    with_views(
        """select ann_id, image_id, 'image_id matches no image' as reason from ann
           where image_id not in (select image_id from img where split = 'train')""",
        "ann",
        "img",
    ),
)
def orphan_annotations(spark, folder):
    images = view(spark, folder, "img").filter("split = 'train'")
    return an.orphans(view(spark, folder, "ann"), images).select("ann_id", "image_id", "reason")


@query(
    "bad_file_names",
    with_views(
        """with named as (select image_id, case image_id % 13 when 2 then '/abs/' || file_name
                          when 4 then 'a/../' || file_name when 6 then 'shelf/.hidden' else file_name end as file_name
                          from img)
        select image_id, file_name, case when file_name like '/%' or regexp_matches(file_name, '(^|/)\\.\\.(/|$)')
               then 'absolute or escaping path' else 'unsupported extension' end as reason from named
        where file_name like '/%' or regexp_matches(file_name, '(^|/)\\.\\.(/|$)')
           or not regexp_matches(lower(file_name), '[^/]\\.(jpg|jpeg|png|webp|bmp)$')""",
        "img",
    ),
)
def bad_file_names(spark, folder):
    name, key = F.col("file_name"), F.col("image_id") % 13
    broken = (
        F.when(key == 2, F.concat(F.lit("/abs/"), name))
        .when(key == 4, F.concat(F.lit("a/../"), name))
        .when(key == 6, F.lit("shelf/.hidden"))
        .otherwise(name)
    )
    images = view(spark, folder, "img").select("image_id", broken.alias("file_name"))
    return an.bad_file_names(images).select("image_id", "file_name", "reason")


_BROKEN = """
    broken as (select image_id, det_idx, case when det_idx = 1 then null else label end as label,
                 case when det_idx = 2 then null when det_idx = 3 then 'nan'::double else score end as score,
                 case when det_idx = 4 then 'inf'::double else x1 end as x1, y1, x2, y2 from det),
    judged as (select *, case when label is null then 'missing label' when score is null then 'missing score'
                 when not isfinite(x1) then 'box is not finite' end as reason from broken)
"""


def _broken(spark, folder):
    index = F.col("det_idx")
    return view(spark, folder, "det").withColumns(
        {
            "label": F.when(index != 1, F.col("label")),
            "score": F.when(index == 3, F.lit(float("nan"))).when(index != 2, F.col("score")),
            "x1": F.when(index == 4, F.lit(float("inf"))).otherwise(F.col("x1")),
        }
    )


@query(
    "validate_detections",
    with_views(f"with {_BROKEN} select coalesce(reason, 'usable') as outcome, count(*) as n from judged group by 1", "det"),
)
def validate_detections(spark, folder):
    good, bad = an.validate_detections(_broken(spark, folder))
    rows = good.select(F.lit("usable").alias("outcome")).unionAll(bad.select("reason"))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "missing_crowd_flags",
    with_views("select image_id, gt_idx, 'missing crowd flag' as reason from gt where gt_idx % 5 = 3", "gt"),
)
def missing_crowd_flags(spark, folder):
    truth = view(spark, folder, "gt").withColumn("iscrowd", F.when(F.col("gt_idx") % 5 != 3, F.col("iscrowd")))
    return an.missing_crowd_flags(truth).select("image_id", "gt_idx", "reason")


def _segmented(spark, folder):
    number = lambda name: F.col(name).cast("string")
    x, y = number("l_partkey"), number("l_suppkey")
    line = F.concat(F.lit("["), x, F.lit(","), y, F.lit(","), x, F.lit(","), F.lit("9]"))
    triangle = F.concat(F.lit("["), x, F.lit(","), y, F.lit(",7,8,"), y, F.lit(","), x, F.lit("]"))
    rle = F.concat(F.lit('{"counts":['), x, F.lit(","), y, F.lit('],"size":[9,9]}'))
    text = (
        F.when(F.col("rn") % 4 == 0, F.concat(F.lit("["), line, F.lit(","), triangle, F.lit("]")))
        .when(F.col("rn") % 4 == 1, rle)
        .when(F.col("rn") % 4 == 2, F.lit("[]"))
    )
    return view(spark, folder, "base").select("image_id", "rn", text.alias("segmentation"))


@query(
    "segmentation_kinds",
    with_views(
        """select case rn % 4 when 0 then 'polygon' when 1 then 'rle' else 'none' end as kind, count(*) as n,
                  cast(sum(case when rn % 4 = 0 then 1 else 0 end) as bigint) as solid_parts
           from base group by 1""",
        "base",
    ),
)
def segmentation_kinds(spark, folder):
    kind = an.segmentation_kind(F.col("segmentation"))
    parts = F.when(kind == "polygon", F.size(an.polygons(F.col("segmentation")))).otherwise(0)
    rows = _segmented(spark, folder).select(F.coalesce(kind, F.lit("none")).alias("kind"), parts.alias("parts"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("parts").alias("solid_parts"))


@query(
    "scale_annotations",
    with_views(
        """select image_id, gt_idx, x1*1.5::double as x, y1*0.25::double as y, (x2-x1)*1.5::double as w,
                  (y2-y1)*0.25::double as h, area*1.5::double*0.25::double as area,
                  keypoints[1]*1.5::double as kx, keypoints[2]*0.25::double as ky, keypoints[3] as kv,
                  x2*1.5::double as px, y2*0.25::double as py
           from target""",
        "target",
    ),
)
def scale_annotations(spark, folder):
    rows = view(spark, folder, "target")
    x, y, w, h = bx.xyxy_to_xywh(bx.box())
    shaped = rows.select(
        "image_id", "gt_idx", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), "area", "keypoints",
        F.array(F.array("x1", "y1", "x2", "y2")).alias("segmentation"),
    )
    scaled = an.scale_annotations(shaped, F.lit(1.5), F.lit(0.25))
    return scaled.select(
        "image_id", "gt_idx", "x", "y", "w", "h", "area",
        F.get("keypoints", 0).alias("kx"), F.get("keypoints", 1).alias("ky"), F.get("keypoints", 2).alias("kv"),
        F.get(F.get("segmentation", 0), 2).alias("px"), F.get(F.get("segmentation", 0), 3).alias("py"),
    )


def _point_columns(prefix: str = "k"):
    return [F.get("keypoints", i).alias(f"{prefix}{i}") for i in range(9)]


def _points_sql(parts: list[str]) -> str:
    return ", ".join(f"{p} as k{i}" for i, p in enumerate(parts))


def _kept_point(p: int, x: str, y: str, w: str, h: str) -> list[str]:
    v = f"keypoints[{3 * p + 3}]"
    rule = f"{v} > 0 and ({x}) >= 0 and ({x}) <= {w} and ({y}) >= 0 and ({y}) <= {h}"
    return [f"case when {rule} then {value} else 0 end" for value in (x, y, v)]


_RESIZE_POINTS = [
    e
    for p in range(3)
    for e in _kept_point(p, f"keypoints[{3 * p + 1}] * nw / width", f"keypoints[{3 * p + 2}] * nh / height", "nw", "nh")
]


@query(
    "resize_targets",
    with_views(
        f"""with sized as (select *, case when width < height then 64 else round_even(64::double * width / height, 0) end as w0,
              case when width < height then round_even(64::double * height / width, 0) else 64 end as h0,
              greatest(width, height)::double / least(width, height) * 64 > 72 as limited,
              round_even(72::double * least(width, height) / greatest(width, height), 0) as short from target),
            picked as (select *, case when limited then short else 64 end as s from sized),
            final as (select *, case when width < height then s else round_even(s * width / height, 0) end as nw,
              case when width < height then round_even(s * height / width, 0) else s end as nh from picked)
        select image_id, gt_idx, cast(nw as int) as width, cast(nh as int) as height,
          x1 * (nw / width) as x1, y1 * (nh / height) as y1, x2 * (nw / width) as x2, y2 * (nh / height) as y2,
          area * ((nw / width) * (nh / height)) as area, {_points_sql(_RESIZE_POINTS)}
        from final""",
        "target",
    ),
)
def resize_targets(spark, folder):
    height, width = tr.resized_shape(F.col("height"), F.col("width"), 64, 72)
    resized = tr.resize(view(spark, folder, "target"), height, width)
    return resized.select("image_id", "gt_idx", "width", "height", "x1", "y1", "x2", "y2", "area", *_point_columns())


_FLIPPED = [_kept_point(p, f"width - keypoints[{3 * p + 1}]", f"keypoints[{3 * p + 2}]", "width", "height") for p in (0, 2, 1)]


@query(
    "flip_targets",
    with_views(
        f"""select image_id, gt_idx, width - x2 as x1, y1, width - x1 as x2, y2,
                   {_points_sql([e for part in _FLIPPED for e in part])} from target""",
        "target",
    ),
)
def flip_targets(spark, folder):
    flipped = tr.flip(view(spark, folder, "target"), pairs=[1, 2])
    return flipped.select("image_id", "gt_idx", "x1", "y1", "x2", "y2", *_point_columns())


_CROP_POINTS = [e for p in range(3) for e in _kept_point(p, f"keypoints[{3 * p + 1}] - 15", f"keypoints[{3 * p + 2}] - 10", "50", "40")]


@query(
    "crop_targets",
    with_views(
        f"""with moved as (select image_id, gt_idx, keypoints,
              least(greatest(x1-15, 0), 50) as x1, least(greatest(y1-10, 0), 40) as y1,
              least(greatest(x2-15, 0), 50) as x2, least(greatest(y2-10, 0), 40) as y2 from target)
        select image_id, gt_idx, x1, y1, x2, y2, (x2-x1)*(y2-y1) as area, {_points_sql(_CROP_POINTS)}
        from moved where x2 > x1 and y2 > y1""",
        "target",
    ),
)
def crop_targets(spark, folder):
    cropped = tr.crop(view(spark, folder, "target"), F.lit(15), F.lit(10), F.lit(50), F.lit(40))
    return cropped.select("image_id", "gt_idx", "x1", "y1", "x2", "y2", "area", *_point_columns())


_CLEAN_POINTS = [e for p in range(3) for e in _kept_point(p, f"keypoints[{3 * p + 1}]", f"keypoints[{3 * p + 2}]", "55", "45")]


@query(
    "clean_after_transform",
    with_views(
        f"""with moved as (select image_id, gt_idx, keypoints, least(x1, 55) as x1, least(y1, 45) as y1,
              least(x2, 55) as x2, least(y2, 45) as y2 from target)
        select image_id, gt_idx, x1, y1, x2, y2, (x2-x1)*(y2-y1) as area, {_points_sql(_CLEAN_POINTS)}
        from moved where x2 > x1 and y2 > y1""",
        "target",
    ),
)
def clean_after_transform(spark, folder):
    cleaned = tr.clean(view(spark, folder, "target"), F.lit(55), F.lit(45))
    return cleaned.select("image_id", "gt_idx", "x1", "y1", "x2", "y2", "area", *_point_columns())


@query(
    "pad_keypoints",
    with_views(
        """select image_id, gt_idx, """
        + ", ".join(f"case when {i} < (gt_idx % 4) * 3 then coalesce(keypoints[{i + 1}], 0) else 0 end as k{i}" for i in range(6))
        + ", 6::int as entries from target",
        "target",
    ),
)
def pad_keypoints(spark, folder):
    cut = F.when(F.col("gt_idx") % 4 != 0, F.slice("keypoints", F.lit(1), (F.col("gt_idx") % 4 * 3).cast("int")))
    padded = an.pad_keypoints(view(spark, folder, "target").withColumn("keypoints", cut), 2)
    return padded.select(
        "image_id", "gt_idx", *[F.get("keypoints", i).alias(f"k{i}") for i in range(6)], F.size("keypoints").alias("entries")
    )


@query(
    "fill_num_keypoints",
    with_views(
        """select image_id, gt_idx, case when gt_idx % 3 = 0 then 99 else
             cast((keypoints[3] > 0)::int + (keypoints[6] > 0)::int + (keypoints[9] > 0)::int as int) end as num_keypoints
           from target""",
        "target",
    ),
)
def fill_num_keypoints(spark, folder):
    rows = view(spark, folder, "target").withColumn("num_keypoints", F.when(F.col("gt_idx") % 3 == 0, F.lit(99)))
    return an.fill_num_keypoints(rows).select("image_id", "gt_idx", "num_keypoints")


@query(
    "pad_targets",
    with_views(
        """with slots as (select image_id, unnest([0, 1, 2]) as slot from img),
        ranked as (select *, row_number() over (partition by image_id order by gt_idx) - 1 as slot from gt)
        select image_id, cast(slot as int) as slot, coalesce(label, 0) as label, coalesce(x1, 0) as x1, coalesce(y2, 0) as y2,
               label is not null as valid
        from slots left join ranked using (image_id, slot)""",
        "gt",
        "img",
    ),
)
def pad_targets(spark, folder):
    padded = an.pad_targets(view(spark, folder, "gt"), view(spark, folder, "img"), 3, ["gt_idx"])
    return padded.select("image_id", "slot", "label", "x1", "y2", "valid")


@query(
    "crowd_regions",
    with_views(
        """with noisy as (select *, case when ann_id % 17 = 3 then null else w end as nw from ann where iscrowd),
        space as (select distinct category_id, (category_id - 1) / 3 as label from ann where category_id <> 7)
        select n.image_id, n.ann_id, cast(s.label as bigint) as label, n.x as x1, n.y as y1, n.x + n.nw as x2, n.y + n.h as y2
        from noisy n join space s using (category_id) where nw is not null""",
        "ann",
    ),
)
def crowd_regions(spark, folder):
    rows = view(spark, folder, "ann")
    space = (
        rows.filter("category_id <> 7").select("category_id").distinct()
        .withColumn("label", ((F.col("category_id") - 1) / 3).cast("long"))
    )
    noisy = rows.withColumn("w", F.when(F.col("ann_id") % 17 != 3, F.col("w")))
    return an.crowd_regions(noisy, space)[0]


@query(
    "add_crowd_regions",
    with_views(
        """select image_id, gt_idx, label, x1, y1, x2, y2, iscrowd from gt union all
           select image_id, ann_id, category_id, x, y, x + w, y + h, true from ann where iscrowd""",
        "ann",
        "gt",
    ),
)
def add_crowd_regions(spark, folder):
    regions, _ = an.crowd_regions(view(spark, folder, "ann"))
    return an.add_crowd_regions(view(spark, folder, "gt"), regions)


@query(
    "sample_range_flags",
    """select vec_id, list_min(embedding)::double as smallest, list_max(embedding)::double as largest,
              list_min(embedding)::double < -0.3 or list_max(embedding)::double > 0.32 as outside from embeddings""",
)
def sample_range_flags(spark, folder):
    flags = an.sample_range_flags(read(spark, folder, "embeddings"), -0.3, 0.32)
    return flags.select("vec_id", "smallest", "largest", "outside")


@query(
    "images_with_annotations",
    with_views(
        """select i.image_id, i.split, count(a.ann_id) as annotations,
                  cast(count(*) filter (a.ann_id is null) as bigint) as background
           from img i left join ann a using (image_id) group by all""",
        "ann",
        "img",
    ),
)
def images_with_annotations(spark, folder):
    rows = an.with_annotations(view(spark, folder, "img"), view(spark, folder, "ann"))
    return rows.groupBy("image_id", "split").agg(
        F.count("ann_id").alias("annotations"), F.count_if(F.col("ann_id").isNull()).alias("background")
    )


@query(
    "keypoint_counts",
    with_views(
        """with declared as (select category_id, case when category_id % 2 = 0 then 4 else 0 end as k from cat),
        seen as (select category_id, 2 + category_id % 3 as k from ann)
        select category_id, cast(max(k) as int) as k
        from (select * from declared union all select * from seen) group by 1 having max(k) > 0""",
        "cat",
        "ann",
    ),
)
def keypoint_counts(spark, folder):
    from gridmark.operators.keypoints import keypoint_counts as count

    names = F.when(F.col("category_id") % 2 == 0, F.array_repeat(F.lit("p"), 4))
    vector = F.array_repeat(F.lit(1.0), ((F.col("category_id") % 3 + 2) * 3).cast("int"))
    return count(
        view(spark, folder, "cat").withColumn("keypoints", names), view(spark, folder, "ann").withColumn("keypoints", vector)
    )


@query(
    "point_scaling_roundtrip",
    with_views(
        "select image_id, gt_idx, cast((keypoints[3] > 0)::int + (keypoints[6] > 0)::int + (keypoints[9] > 0)::int as int)"
        " as visible, keypoints[4] * 2 as x from target",
        "target",
    ),
)
def point_scaling_roundtrip(spark, folder):
    rows = view(spark, folder, "target").withColumn("keypoints", pt.scale_points(F.col("keypoints"), F.lit(2.0), F.lit(3.0)))
    return rows.select(
        "image_id", "gt_idx", pt.visible_count(F.col("keypoints")).alias("visible"), F.get("keypoints", 3).alias("x")
    )
