"""Average precision, its statistics, and keypoint similarity."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gridmark.operators import average_precision as ap
from gridmark.operators import keypoints as kp
from gridmark.operators import sweep as sw
from gridmark.plans import matching_queries as mq
from gridmark.plans.fixtures import read, view, with_views
from gridmark.plans.registry import query

_INTER = "(greatest(least(d.x2,g.x2)-greatest(d.x1,g.x1),0)*greatest(least(d.y2,g.y2)-greatest(d.y1,g.y1),0))"
_OWN = "((d.x2-d.x1)*(d.y2-d.y1))"
_IOU = f"({_INTER} / greatest({_OWN} + (g.x2-g.x1)*(g.y2-g.y1) - {_INTER}, 1e-7))"


def protocol_sql(pairs: str, truth: str, found: str, cap: int) -> str:
    """The published protocol over tables ``pairs`` (…, overlap, crowd, garea), truth and found (with area)."""
    return f"""
    iou_grid as (select unnest([{", ".join(repr(t) for t in ap.IOU_GRID)}]::double[]) as iou),
    areas as (select * from (values ('all', 0::double, 1e10::double), ('small', 0, 1024), ('medium', 1024, 9216),
              ('large', 9216, 1e10)) v(area_range, low, high)),
    lanes as (select * from iou_grid cross join areas),
    truth as ({truth}),
    found as (select * from (select *, row_number() over (partition by image_id, label order by score desc, det_idx) - 1 as rank
              from ({found})) where rank < {cap}),
    pairs as ({pairs}),
    cand as (select p.image_id, p.label, p.det_idx, l.iou, l.area_range,
               list(struct_pack(g := gt_idx, c := crowd, i := crowd or garea < low or garea > high)
                    order by (crowd or garea < low or garea > high), overlap desc, gt_idx desc) as open
             from pairs p join lanes l on p.overlap >= least(l.iou, 1 - 1e-10) group by all),
    ranked as (select c.*, row_number() over (partition by c.image_id, c.label, iou, area_range order by f.rank) as rk
               from cand c join found f using (image_id, label, det_idx)),
    walk as (
      select image_id, label, iou, area_range, 0::bigint as rk, []::bigint[] as used, 0::bigint as det_idx,
             null::struct(g bigint, c boolean, i boolean) as pick
      from (select distinct image_id, label, iou, area_range from ranked)
      union all
      select image_id, label, iou, area_range, rk, case when pick is null or pick.c then used else list_append(used, pick.g) end,
             det_idx, pick
      from (select r.image_id, r.label, r.iou, r.area_range, r.rk, w.used, r.det_idx,
                   list_filter(r.open, lambda x: x.c or not list_contains(w.used, x.g))[1] as pick
            from walk w join ranked r on r.image_id = w.image_id and r.label = w.label and r.iou = w.iou
              and r.area_range = w.area_range and r.rk = w.rk + 1)),
    hits as (select * from walk where rk > 0 and pick is not null),
    lane_rows as (select f.label, l.iou, l.area_range, f.image_id, f.rank, f.score,
               h.pick is not null and not h.pick.i as tp,
               (h.pick is not null and h.pick.i) or (h.pick is null and (f.area < l.low or f.area > l.high)) as ign
             from found f cross join lanes l left join hits h on h.image_id = f.image_id and h.label = f.label
               and h.det_idx = f.det_idx and h.iou = l.iou and h.area_range = l.area_range),
    npig as (select k.label, a.area_range, count(t.label) as positives
             from (select label from truth union select label from found) k cross join areas a
             left join truth t on t.label = k.label and not t.crowd and t.garea >= a.low and t.garea <= a.high group by all),
    curve as (select *, sum(tp::int) over w as ctp, sum((not ign)::int) over w as seen from lane_rows
              window w as (partition by label, iou, area_range order by score desc, image_id, rank)),
    points as (select c.label, c.iou, c.area_range, c.rank, c.ctp::double / n.positives::double as recall,
                 c.ctp::double / c.seen::double as precision
               from curve c join npig n using (label, area_range) where c.tp),
    binned as (select *, floor(recall * 100)::int as k from points),
    reached as (select *, case when (k + 1) * 0.01::double <= recall then k + 1 when k * 0.01::double <= recall then k
                  else k - 1 end as level from binned),
    peaks as (select label, iou, area_range, level, max(precision) as peak from reached group by all),
    levels as (select unnest(generate_series(0, 100)) as level),
    raw_precision as (select n.label, g.iou, n.area_range, v.level, n.positives, p.peak
      from npig n cross join iou_grid g cross join levels v left join peaks p
        on p.label = n.label and p.iou = g.iou and p.area_range = n.area_range and p.level = v.level),
    precisions as (select label, iou, area_range, level, case when positives > 0 then coalesce(
        max(peak) over (partition by label, iou, area_range order by level desc), 0) end as precision from raw_precision),
    caps as (select unnest([1, 10, 100]) as max_dets),
    recalls as (select n.label, g.iou, n.area_range, c.max_dets, case when n.positives > 0 then
        count(p.rank)::double / n.positives::double end as recall
      from npig n cross join iou_grid g cross join caps c left join points p on p.label = n.label and p.iou = g.iou
        and p.area_range = n.area_range and p.rank < c.max_dets group by n.label, g.iou, n.area_range, c.max_dets, n.positives)
"""


_BOX_PAIRS = f"""select d.image_id, d.label, d.det_idx, g.gt_idx, g.crowd, g.garea,
    case when g.crowd then {_INTER} / {_OWN} else {_IOU} end as overlap
    from found d join truth g using (image_id, label)"""
_BOX_TRUTH = "select image_id, label, gt_idx, iscrowd as crowd, x1, y1, x2, y2, (x2-x1)*(y2-y1) as garea from gt"
_BOX_FOUND = "select *, (x2-x1)*(y2-y1) as area from det"
PROTOCOL = protocol_sql(_BOX_PAIRS, _BOX_TRUTH, _BOX_FOUND, 100)

STATISTICS = """
    stats as (
      select s as statistic, coalesce(avg(precision) filter (
        case s when 'AP50' then abs(iou - 0.5) < 1e-9 when 'AP75' then abs(iou - 0.75) < 1e-9 else true end
        and area_range = case s when 'APs' then 'small' when 'APm' then 'medium' when 'APl' then 'large' else 'all' end), -1) as value
      from precisions cross join (select unnest(['AP','AP50','AP75','APs','APm','APl']) as s) group by 1
      union all
      select s, coalesce(avg(recall) filter (max_dets = case s when 'AR1' then 1 when 'AR10' then 10 else 100 end
        and area_range = case s when 'ARs' then 'small' when 'ARm' then 'medium' when 'ARl' then 'large' else 'all' end), -1)
      from recalls cross join (select unnest(['AR1','AR10','AR100','ARs','ARm','ARl']) as s) group by 1)
"""


def _sql(select: str, *parts: str) -> str:
    return with_views("with recursive " + ",".join((PROTOCOL, *parts)) + select, "det", "gt", recursive=True)


def evaluation(spark, folder):
    return ap.evaluate(*mq.sides(spark, folder))


@query("interpolated_precision", _sql(
    " select label, area_range, round(iou::double, 2) as iou, level::int as recall_percent, precision from precisions"))
def interpolated_precision(spark, folder):
    rows = evaluation(spark, folder).precision
    return rows.select(
        "label", "area_range", F.round("iou", 2).alias("iou"), F.round(F.col("recall_level") * 100).cast("int").alias("recall_percent"),
        "precision",
    )


@query("average_recall_rows", _sql(
    " select label, area_range, round(iou::double, 2) as iou, max_dets, recall from recalls"))
def average_recall_rows(spark, folder):
    rows = evaluation(spark, folder).recall
    return rows.select("label", "area_range", F.round("iou", 2).alias("iou"), "max_dets", "recall")


@query("box_statistics", _sql(" select statistic, round(value, 9) as value from stats", STATISTICS))
def box_statistics(spark, folder):
    return ap.summarize_boxes(evaluation(spark, folder)).withColumn("value", F.round("value", 9))


_PER_CLASS = """
    per_class as (select a.label, a.ap, r.ar from
      (select label, coalesce(avg(precision), -1) as ap from precisions where area_range = 'all' group by 1) a join
      (select label, coalesce(avg(recall), -1) as ar from recalls where area_range = 'all' and max_dets = 100 group by 1) r
      using (label))
"""


@query("class_average_precision", _sql(
    " select label, round(ap, 9) as ap, round(ar, 9) as ar from per_class", _PER_CLASS))
def class_average_precision(spark, folder):
    rows = ap.per_class(evaluation(spark, folder))
    return rows.select("label", F.round("ap", 9).alias("ap"), F.round("ar", 9).alias("ar"))


# The report joins two different matchings, so the sweep's common table expressions get their own names.
_F1_PARTS = mq.MATCHED + "," + mq.SWEEP
for _name in ("pairs", "cand", "ranked", "walk", "classes", "rates", "scores", "macro", "best", "grid", "matched", "totals"):


    _F1_PARTS = re.sub(rf"\b{_name}\b", f"f_{_name}", _F1_PARTS)


@query("class_report", _sql(
    """ select coalesce(n.n_name, p.label::varchar) as name, p.label, round(p.ap, 9) as ap, round(p.ar, 9) as ar,
          round(s.f1, 12) as f1, round(s.precision, 12) as precision, round(s.recall, 12) as recall
        from per_class p left join f_scores s on s.label = p.label and s.threshold = (select threshold from f_best)
        left join (select * from nation where n_nationkey < 2) n on n.n_nationkey = p.label where not (p.ap < 0 and p.ar < 0)""",
    _PER_CLASS, _F1_PARTS))
def class_report(spark, folder):
    names = read(spark, folder, "nation").filter("n_nationkey < 2").select(
        F.col("n_nationkey").cast("long").alias("label"), F.col("n_name").alias("name")
    )
    f1 = sw.class_scores_at_best(mq.by_class(spark, folder), 12)
    rows = ap.per_class_report(ap.per_class(evaluation(spark, folder)), names, f1)
    return rows.select(
        "name", "label", F.round("ap", 9).alias("ap"), F.round("ar", 9).alias("ar"),
        *[F.round(c, 12).alias(c) for c in ("f1", "precision", "recall")],
    )


@query("size_buckets", with_views(
    """with g as (select *, case when gt_idx % 4 = 1 then 0 when gt_idx % 4 = 2 then 9300 else null end as stored,
         (x2-x1)*(y2-y1) as box from gt),
       a as (select case when stored > 0 then stored else box end as area from g)
       select case when area < 1024 then 'small' when area < 9216 then 'medium' else 'large' end as size, count(*) as n
       from a group by 1""", "gt"))  # fmt: skip
def size_buckets(spark, folder):
    key = F.col("gt_idx") % 4
    stored = F.when(key == 1, F.lit(0.0)).when(key == 2, F.lit(9300.0))
    rows = ap.truth_areas(view(spark, folder, "gt").withColumn("area", stored))
    return rows.groupBy(ap.size_name(F.col("area")).alias("size")).agg(F.count("*").alias("n"))


_SUBSET = protocol_sql(
    _BOX_PAIRS,
    _BOX_TRUTH + " where image_id in (select image_id from img where split = 'val')",
    _BOX_FOUND + " where image_id in (select image_id from img where split = 'val')",
    100,
)


@query("subset_average_precision", with_views(
    f"with recursive {_SUBSET}, {STATISTICS} select statistic, greatest(round(value, 9), 0) as value from stats"
    " where statistic in ('AP', 'AP50')", "det", "gt", "img", recursive=True))  # fmt: skip
def subset_average_precision(spark, folder):
    subset = view(spark, folder, "img").filter("split = 'val'")
    rows = ap.evaluate_subset(*mq.sides(spark, folder), subset)
    return rows.withColumn("value", F.round("value", 9))


@query("subset_without_detections", with_views(
    "select unnest(['AP', 'AP50']) as statistic, 0::double * (select count(*) from gt) as value", "gt"))
def subset_without_detections(spark, folder):
    detections, truth = mq.sides(spark, folder)
    return ap.evaluate_subset(detections.filter("score > 1"), truth, view(spark, folder, "img").select("image_id"))


# --- keypoints: label 0 has 3 points, label 1 has 2, label 2 has 1 -------------------------------------------------

_KP_GT = """
    kp_truth as (select image_id, gt_idx, label, x1, y1, x2, y2, iscrowd, (x2-x1)*(y2-y1) as area,
      [x1+4, y1+4, (gt_idx % 3)::double, x1+9, y1+12, (gt_idx % 2)::double, x2-3, y2-5, ((gt_idx + 1) % 3)::double] as full_points
      from gt),
    kp_found as (select image_id, det_idx, label, score, x1, y1, x2, y2,
      [x1+4, y1+5, 1, x1+10, y1+12, 1, x2-3, y2-6, 1] as points from det),
    kp_pair as (select d.image_id, d.label, d.det_idx, g.gt_idx, g.iscrowd, g.area, d.points, g.full_points as gp,
      g.x1, g.y1, g.x2 - g.x1 as w, g.y2 - g.y1 as h, 3 - g.label as k,
      len(list_filter([g.full_points[3], case when g.label < 2 then g.full_points[6] else 0 end, case when g.label = 0 then g.full_points[9] else 0 end], lambda v: v > 0)) as labelled
      from kp_found d join kp_truth g using (image_id, label)),
    kp_term as (select *, unnest(generate_series(0, k - 1)) as i from kp_pair),
    kp_dist as (select *,
      case when labelled > 0 then points[3*i+1] - gp[3*i+1] else greatest(0, (x1 - w) - points[3*i+1]) + greatest(0, points[3*i+1] - (x1 + 2*w)) end as dx,
      case when labelled > 0 then points[3*i+2] - gp[3*i+2] else greatest(0, (y1 - h) - points[3*i+2]) + greatest(0, points[3*i+2] - (y1 + 2*h)) end as dy
      from kp_term),
    kp_similar as (select image_id, label, det_idx, gt_idx, iscrowd, area, labelled,
      avg(exp(-((dx*dx + dy*dy) / pow(2 * 0.05000000074505806::double, 2) / (area + 2.220446049250313e-16) / 2)))
        filter (labelled = 0 or gp[3*i+3] > 0) as overlap
      from kp_dist group by all)
"""


def _keypoint_sides(spark, folder):
    detections, truth = mq.sides(spark, folder)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    key = F.col("gt_idx")
    one = F.lit(1.0)
    points = [
        x1 + 4, y1 + 4, (key % 3).cast("double"), x1 + 9, y1 + 12, (key % 2).cast("double"),
        x2 - 3, y2 - 5, ((key + 1) % 3).cast("double"),
    ]
    size = F.when(F.col("label") == 0, F.lit(9)).when(F.col("label") == 1, F.lit(6)).otherwise(F.lit(3))
    truth = truth.withColumns(
        {"keypoints": F.slice(F.array(*points), F.lit(1), size), "area": (x2 - x1) * (y2 - y1), "num_keypoints": F.lit(None).cast("int")}
    )
    found = F.array(x1 + 4, y1 + 5, one, x1 + 10, y1 + 12, one, x2 - 3, y2 - 6, one)
    detections = detections.withColumn("keypoints", found)
    annotations = truth.select(F.col("label").alias("category_id"), "keypoints")
    declared = view(spark, folder, "cat").filter("category_id < 0").withColumn("keypoints", F.array(F.col("name")))
    return detections, truth, kp.keypoint_counts(declared, annotations)


@query("keypoint_similarity", with_views(
    f"with {_KP_GT} select image_id, label, det_idx, gt_idx, round(overlap, 9) as overlap from kp_similar",
    "det", "gt"))
def keypoint_similarity(spark, folder):
    pairs = kp.similarity_pairs(*_keypoint_sides(spark, folder))
    return pairs.withColumn("overlap", F.round("overlap", 9))


_KP_PROTOCOL = protocol_sql(
    """select s.image_id, s.label, s.det_idx, s.gt_idx, s.iscrowd as crowd, case when labelled = 0 then -1 else s.area end as garea,
         s.overlap from kp_similar s join found f using (image_id, label, det_idx)""",
    """select image_id, label, gt_idx, iscrowd as crowd, case when len(list_filter([full_points[3], case when label < 2 then full_points[6] else 0 end,
         case when label = 0 then full_points[9] else 0 end], lambda v: v > 0)) = 0 then -1 else area end as garea from kp_truth""",
    "select *, (x2-x1)*(y2-y1) as area from kp_found",
    20,
)
_KP_STATS = """
    stats as (
      select 'AP' || s as statistic, coalesce(avg(precision) filter (
        case s when '50' then abs(iou - 0.5) < 1e-9 when '75' then abs(iou - 0.75) < 1e-9 else true end
        and area_range = case s when 'm' then 'medium' when 'l' then 'large' else 'all' end), -1) as value
      from precisions cross join (select unnest(['','50','75','m','l']) as s) group by 1
      union all
      select 'AR' || s, coalesce(avg(recall) filter (max_dets = 100 and
        case s when '50' then abs(iou - 0.5) < 1e-9 when '75' then abs(iou - 0.75) < 1e-9 else true end
        and area_range = case s when 'm' then 'medium' when 'l' then 'large' else 'all' end), -1)
      from recalls cross join (select unnest(['','50','75','m','l']) as s) group by 1)
"""


@query("keypoint_statistics", with_views(
    f"with recursive {_KP_GT}, {_KP_PROTOCOL}, {_KP_STATS} select statistic, round(value, 9) as value from stats",
    "det", "gt", recursive=True))
def keypoint_statistics(spark, folder):
    result = kp.evaluate_keypoints(*_keypoint_sides(spark, folder))
    return ap.summarize_keypoints(result).withColumn("value", F.round("value", 9))
