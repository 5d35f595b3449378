"""From raw outputs to detections, thresholds, names, keypoints, costs and parity."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmark.operators import costs
from gridmark.operators import decode as dc
from gridmark.operators import labels as lb
from gridmark.plans.fixtures import read, view, with_views
from gridmark.plans.registry import query

_SCORED = """
    scored as (select image_id, query_idx, cast(label - 1 as bigint) as label, logit,
                 1 / (1 + exp(-logit)) as score, cast(query_idx * 8 + label - 1 as bigint) as flat_idx, cx, cy, w, h
               from (select *, unnest(logits) as logit, unnest([1,2,3,4,5,6,7,8]) as label from raw))
"""


@query(
    "topk_queries",
    with_views(
        f"""with {_SCORED}
        select image_id, query_idx, label, flat_idx, cast(det_idx as int) as det_idx, round(score, 9) as score from (
          select *, row_number() over (partition by image_id order by score desc, flat_idx) - 1 as det_idx from scored)
        where det_idx < 12""",
        "raw",
    ),
)
def topk_queries(spark, folder):
    best = dc.select_topk(dc.explode_scores(view(spark, folder, "raw")), 12)
    return best.select("image_id", "query_idx", "label", "flat_idx", "det_idx", F.round("score", 9).alias("score"))


@query(
    "decode_detections",
    with_views(
        f"""with {_SCORED},
        best as (select * from (select *, row_number() over (partition by image_id order by score desc, flat_idx) - 1 as det_idx
                 from scored where label <> 2) where det_idx < 20 and score > 0.52)
        select image_id, query_idx, label, cast(det_idx as int) as det_idx, round(score, 9) as score,
          least(greatest((cx - w*0.5::double)*width, 0), width) as x1, least(greatest((cy - h*0.5::double)*height, 0), height) as y1,
          least(greatest((cx + w*0.5::double)*width, 0), width) as x2, least(greatest((cy + h*0.5::double)*height, 0), height) as y2
        from best join img using (image_id)""",
        "raw",
        "img",
    ),
)
def decode_detections(spark, folder):
    rows = dc.decode(view(spark, folder, "raw"), view(spark, folder, "img"), 0.52, 20, background_label=2)
    return rows.select(
        "image_id", "query_idx", "label", "det_idx", F.round("score", 9).alias("score"), "x1", "y1", "x2", "y2"
    )


@query(
    "scale_boxes_to_pixels",
    with_views(
        """select image_id, query_idx,
          least(greatest((cx - greatest(w, 0)*0.5::double)*width, 0), width) as x1,
          least(greatest((cy - greatest(h, 0)*0.5::double)*height, 0), height) as y1,
          least(greatest((cx + greatest(w, 0)*0.5::double)*width, 0), width) as x2,
          least(greatest((cy + greatest(h, 0)*0.5::double)*height, 0), height) as y2
        from raw join img using (image_id)""",
        "raw",
        "img",
    ),
)
def scale_boxes_to_pixels(spark, folder):
    placed = dc.place_boxes(view(spark, folder, "raw"), view(spark, folder, "img"))
    return placed.select("image_id", "query_idx", "x1", "y1", "x2", "y2")


def _names(spark, folder):
    # Labels 0 to 23; the class names are those of the nations, 24 and above have none.
    return read(spark, folder, "nation").filter("n_nationkey < 24").select(
        F.col("n_nationkey").cast("long").alias("label"), F.col("n_name").alias("name")
    )


@query(
    "class_threshold_filter",
    with_views(
        """with d as (select image_id, det_idx, (image_id + det_idx) % 27 as label,
                        case when det_idx = 5 then 'nan'::double else score end as score from det)
        select image_id, det_idx, label, score from d
        where label < 24 and not isnan(score) and score > case label when 3 then 0.25 when 7 then 0.8 else 0.5 end""",
        "det",
    ),
)
def class_threshold_filter(spark, folder):
    detections = view(spark, folder, "det").withColumns(
        {
            "label": (F.col("image_id") + F.col("det_idx")) % 27,
            "score": F.when(F.col("det_idx") == 5, F.lit(float("nan"))).otherwise(F.col("score")),
        }
    )
    table = dc.threshold_table(_names(spark, folder), {"NATION_3": 0.25, "NATION_7": 0.8})
    return dc.apply_class_thresholds(detections, table).select("image_id", "det_idx", "label", "score")


@query(
    "class_names",
    with_views(
        """select image_id, det_idx, (image_id + det_idx) % 27 as label,
             coalesce(n_name, case when (image_id + det_idx) % 27 = 24 then '__background__' else '' end) as class_name
           from det left join (select * from nation where n_nationkey < 24) on n_nationkey = (image_id + det_idx) % 27""",
        "det",
    ),
)
def class_names(spark, folder):
    detections = view(spark, folder, "det").withColumn("label", (F.col("image_id") + F.col("det_idx")) % 27)
    return lb.name_classes(detections, _names(spark, folder), 24).select("image_id", "det_idx", "label", "class_name")


# Two class slots with 2 and 1 points of 7 numbers each, padded to 2 points per slot: 28 entries of the vector.
_POINT = "list_value({})"


def _raw_points(spark, folder):
    base = [F.col("embedding")[i].cast("double") for i in range(64)]
    points = [F.array(*base[30 + 7 * p : 37 + 7 * p]) for p in range(4)]
    return view(spark, folder, "raw").select("image_id", "query_idx", F.array(*points).alias("points"))


def _point_sql(p: int) -> str:
    e = [f"cast(embedding[{31 + 7 * p + i}] as double)" for i in range(7)]
    t1, t2 = f"(-2 * {e[4]})", f"(-2 * {e[6]})"
    t3 = f"(2 * ln(greatest(abs({e[5]}), 1e-12)) + {t1} + {t2})"
    trace = f"(exp({t1}) + exp({t2}) + exp({t3}))"
    weight = f"(1 / (1 + exp(-{e[2]})))"
    return f"struct_pack(x := {e[0]}, y := {e[1]}, c := {weight}, trace := {trace})"


_KEYPOINTS_SQL = f"""
    with {_SCORED},
    best as (select * from (select *, row_number() over (partition by image_id order by score desc, flat_idx) - 1 as det_idx
             from scored) where det_idx < 9),
    points as (select image_id, query_idx, [{", ".join(_point_sql(p) for p in range(4))}] as p from raw),
    picked as (select b.*, width, height, case label when 0 then p[1:2] when 1 then p[3:3] else [] end as p
               from best b join points using (image_id, query_idx) join img using (image_id)),
    fused as (select *, case when len(p) = 0 then 0 else
                ln(list_sum(list_transform(p, lambda q: q.trace * q.c)) / list_sum(list_transform(p, lambda q: q.c))) end as t
              from picked)
"""


@query(
    "keypoint_decode",
    with_views(
        f"""{_KEYPOINTS_SQL}
        select image_id, query_idx, label, cast(len(p) as int) as points,
          round(case when label < 2 then least(1 / (1 + exp(-(ln(score) - 0.2 * t))), 1 - pow(2, -24)) else score end, 7) as score,
          round(p[1].x * width, 7) as x, round(p[1].y * height, 7) as y, round(p[1].c, 7) as confidence from fused""",
        "raw",
        "img",
    ),
)
def keypoint_decode(spark, folder):
    rows = _decoded(spark, folder)
    first = F.get("keypoints", 0)
    return rows.select(
        "image_id", "query_idx", "label", F.size("keypoints").alias("points"), F.round("score", 7).alias("score"),
        F.round(first["x"], 7).alias("x"), F.round(first["y"], 7).alias("y"),
        F.round(first["confidence"], 7).alias("confidence"),
    )


def _decoded(spark, folder):
    scored = dc.explode_scores(view(spark, folder, "raw"))
    best = dc.select_topk(scored, 9)
    return dc.decode_keypoints(best, _raw_points(spark, folder), view(spark, folder, "img"), [2, 1])


@query(
    "keypoint_rows",
    with_views(
        f"""{_KEYPOINTS_SQL}
        select image_id, query_idx, label, keypoint_idx, round(q.x * width, 7) as x, round(q.y * height, 7) as y
        from (select *, unnest(p) as q, unnest(generate_series(0, len(p) - 1))::int as keypoint_idx from fused where len(p) > 0)
        where q.c >= 0.5 and not (abs(q.x * width) <= 1e-8 and abs(q.y * height) <= 1e-8)""",
        "raw",
        "img",
    ),
)
def keypoint_rows(spark, folder):
    rows = dc.keypoint_rows(_decoded(spark, folder), 0.5)
    return rows.select(
        "image_id", "query_idx", "label", "keypoint_idx", F.round("x", 7).alias("x"), F.round("y", 7).alias("y")
    )


@query(
    "pixel_covariance",
    """with e as (select vec_id, embedding[35]::double as a, case when vec_id % 9 = 4 then 'nan'::double
                    else embedding[36]::double end as b, case when vec_id % 9 = 5 then -400 else embedding[37]::double end as c
                  from embeddings),
    l as (select *, exp(a) as l11, exp(c) as l22 from e),
    p as (select *, case when l11*l11*l22*l22 = 0 then null else 1 / (l11*l11*l22*l22) end as inv from l),
    v as (select vec_id, a, b, c, 120.0*120.0*(inv*(b*b + l22*l22)) as xx, 120.0*80.0*(inv*(-l11*b)) as xy,
            80.0*80.0*(inv*(l11*l11)) as yy from p),
    f as (select *, coalesce(isfinite(b) and isfinite(xx) and isfinite(xy) and isfinite(yy), false) as ok from v)
    select vec_id, case when ok then round(xx, 4) end as xx, case when ok then round(xy, 4) end as xy,
           case when ok then round(yy, 4) end as yy from f""",
)
def pixel_covariance(spark, folder):
    e = F.col("embedding")
    b = F.when(F.col("vec_id") % 9 == 4, F.lit(float("nan"))).otherwise(e[35].cast("double"))
    c = F.when(F.col("vec_id") % 9 == 5, F.lit(-400.0)).otherwise(e[36].cast("double"))
    value = dc.pixel_covariance(e[34].cast("double"), b, c, F.lit(120.0), F.lit(80.0))
    rows = read(spark, folder, "embeddings").select("vec_id", value.alias("v"))
    return rows.select("vec_id", *[F.round(f"v.{n}", 4).alias(n) for n in ("xx", "xy", "yy")])


_TARGETS = """
    targets as (select image_id, gt_idx as target_idx, label, (x1+x2)/240 as cx, (y1+y2)/240 as cy,
                  (x2-x1)/120 as w, (y2-y1)/120 as h from gt)
"""


def _targets(spark, folder):
    return view(spark, folder, "gt").select(
        "image_id", F.col("gt_idx").alias("target_idx"), "label",
        ((F.col("x1") + F.col("x2")) / 240).alias("cx"), ((F.col("y1") + F.col("y2")) / 240).alias("cy"),
        ((F.col("x2") - F.col("x1")) / 120).alias("w"), ((F.col("y2") - F.col("y1")) / 120).alias("h"),
    )


_PAIR = """
    pair as (select r.image_id, r.query_idx, t.target_idx, logits[cast(t.label as int) + 1] as z,
               abs(r.cx-t.cx) + abs(r.cy-t.cy) + abs(r.w-t.w) + abs(r.h-t.h) as box_cost,
               r.cx - greatest(r.w,0)/2 as ax1, r.cy - greatest(r.h,0)/2 as ay1,
               r.cx + greatest(r.w,0)/2 as ax2, r.cy + greatest(r.h,0)/2 as ay2,
               t.cx - t.w/2 as bx1, t.cy - t.h/2 as by1, t.cx + t.w/2 as bx2, t.cy + t.h/2 as by2
             from raw r join targets t using (image_id)),
    geo as (select *, 1/(1+exp(-z)) as p,
              greatest(least(ax2,bx2)-greatest(ax1,bx1),0)*greatest(least(ay2,by2)-greatest(ay1,by1),0) as inter,
              (ax2-ax1)*(ay2-ay1) + (bx2-bx1)*(by2-by1) as both_areas,
              (greatest(ax2,bx2)-least(ax1,bx1))*(greatest(ay2,by2)-least(ay1,by1)) as hull from pair),
    cost as (select image_id, query_idx, target_idx, box_cost,
               0.25*pow(1-p,2)*(-ln(p)) - 0.75*pow(p,2)*(-ln(1-p)) as class_cost,
               -(inter/greatest(both_areas-inter,1e-7) - (hull-(both_areas-inter))/greatest(hull,1e-7)) as giou_cost
             from geo)
"""


@query(
    "assignment_costs",
    with_views(
        f"""with {_TARGETS}, {_PAIR}
        select image_id, query_idx, target_idx, round(class_cost, 8) as class_cost, round(box_cost, 8) as box_cost,
               round(giou_cost, 8) as giou_cost, round(5*box_cost + 2*class_cost + 2*giou_cost, 8) as cost from cost""",
        "raw",
        "gt",
    ),
)
def assignment_costs(spark, folder):
    rows = costs.assignment_costs(view(spark, folder, "raw"), _targets(spark, folder))
    return rows.select(
        "image_id", "query_idx", "target_idx",
        *[F.round(c, 8).alias(c) for c in ("class_cost", "box_cost", "giou_cost", "cost")],
    )


@query(
    "replace_non_finite_costs",
    with_views(
        f"""with {_TARGETS}, {_PAIR},
        noisy as (select image_id, query_idx, target_idx, case when query_idx % 5 = 2 then 'nan'::double
                    when query_idx % 5 = 3 then 'inf'::double else box_cost end as c from cost),
        top as (select max(c) + max(abs(c)) + 1 as s from noisy where isfinite(c))
        select image_id, query_idx, target_idx, round(case when isfinite(c) then c else (select s from top) end, 8) as cost
        from noisy""",
        "raw",
        "gt",
    ),
)
def replace_non_finite_costs(spark, folder):
    rows = costs.assignment_costs(view(spark, folder, "raw"), _targets(spark, folder))
    key = F.col("query_idx") % 5
    noisy = F.when(key == 2, F.lit(float("nan"))).when(key == 3, F.lit(float("inf"))).otherwise(F.col("box_cost"))
    replaced = costs.replace_non_finite(rows.select("image_id", "query_idx", "target_idx", noisy.alias("cost")))
    return replaced.withColumn("cost", F.round("cost", 8))


_OTHER = """
    other as (select image_id, query_idx, list_transform(logits, lambda x: x * 1.01::double) as logits,
                cx + 0.001::double * (query_idx % 3) as cx, cy, w * 0.99::double as w, h from raw where query_idx <> 7)
"""


def _other(spark, folder):
    rows = view(spark, folder, "raw").filter("query_idx <> 7")
    return rows.select(
        "image_id", "query_idx", F.transform("logits", lambda x: x * 1.01).alias("logits"),
        (F.col("cx") + (F.col("query_idx") % 3) * 0.001).alias("cx"), "cy", (F.col("w") * 0.99).alias("w"), "h",
    )


@query(
    "runtime_parity",
    with_views(
        f"""with {_OTHER},
        j as (select a.logits as l, b.logits as m, a.cx - b.cx as dx, a.w - b.w as dw from raw a join other b
              using (image_id, query_idx) where 1/(1+exp(-list_max(a.logits))) > 0.53)
        select round(max(list_max(list_transform(list_zip(l, m), lambda z: abs(z[1] - z[2])))), 10) as max_logit_drift,
               round(max(greatest(abs(dx), abs(dw))), 10) as max_box_drift, count(*) as queries from j""",
        "raw",
    ),
)
def runtime_parity(spark, folder):
    result = costs.parity(view(spark, folder, "raw"), _other(spark, folder), 0.53)
    return result.select(
        F.round("max_logit_drift", 10).alias("max_logit_drift"), F.round("max_box_drift", 10).alias("max_box_drift"), "queries"
    )


@query(
    "runtime_parity_nothing_confident",
    with_views(
        "select cast(null as double) as max_logit_drift, cast(null as double) as max_box_drift, count(*) as queries"
        " from raw where 1/(1+exp(-list_max(logits))) > 0.99",
        "raw",
    ),
)
def runtime_parity_nothing_confident(spark, folder):
    return costs.parity(view(spark, folder, "raw"), _other(spark, folder), 0.99)


@query(
    "cardinality_error",
    with_views(
        """with p as (select image_id, count(*) filter (1/(1+exp(-list_max(logits))) > 0.5) as predicted from raw group by 1),
        t as (select image_id, count(*) as wanted from gt group by 1)
        select round(avg(abs(predicted - coalesce(wanted, 0))), 9) as cardinality_error, count(*) as images
        from p left join t using (image_id)""",
        "raw",
        "gt",
    ),
)
def cardinality_error(spark, folder):
    result = costs.cardinality_error(view(spark, folder, "raw"), view(spark, folder, "gt"))
    return result.select(F.round("cardinality_error", 9).alias("cardinality_error"), "images")


@query(
    "focal_costs",
    with_views(
        f"""with {_SCORED} select image_id, query_idx, label,
            round(0.25*pow(1-score,2)*(-ln(score)) - 0.75*pow(score,2)*(-ln(1-score)), 9) as cost from scored""",
        "raw",
    ),
)
def focal_costs(spark, folder):
    from gridmark.functions.scalars import focal_cost

    rows = view(spark, folder, "raw").select("image_id", "query_idx", F.posexplode("logits").alias("label", "logit"))
    return rows.select(
        "image_id", "query_idx", F.col("label").cast("long").alias("label"), F.round(focal_cost(F.col("logit")), 9).alias("cost")
    )


@query("score_images_plugin", with_views(
    """with raw as (
         select vec_id // 10 as image_id, vec_id % 10 as query_idx, l as label, embedding[l + 1]::double as logit
         from (select vec_id, embedding, unnest(range(8)) as l from embeddings)),
       scored as (
         select image_id, query_idx * 8 + label as flat_idx, label,
                1 / (1 + exp(-greatest(least(logit, 88.0), -88.0))) as score from raw),
       ranked as (select *, row_number() over (partition by image_id order by score desc, flat_idx) - 1 as det_idx
                  from scored where score > 0.5)
       select r.image_id, det_idx::int as det_idx, label::bigint as label, round(score, 9) as score
       from ranked r join img using (image_id) where det_idx < 300""", "img"))  # fmt: skip
def score_images_plugin(spark, folder):
    """Any model can feed the pipeline; this one reads the class scores from the stored vectors."""

    def run(batches):
        for batch in batches:
            batch["query_idx"] = batch["vec_id"] % 10
            batch["image_id"] = batch["vec_id"] // 10
            batch["logits"] = [vector[:8].astype("float64") for vector in batch["embedding"]]
            for position, name in enumerate(("cx", "cy", "w", "h")):
                batch[name] = [float(vector[20 + position]) + 0.5 for vector in batch["embedding"]]
            yield batch[["image_id", "query_idx", "logits", "cx", "cy", "w", "h"]]

    raw = dc.score_images(read(spark, folder, "embeddings").select("vec_id", "embedding"), run)
    found = dc.decode(raw, view(spark, folder, "img"), 0.5)
    return found.select("image_id", "det_idx", "label", F.round("score", 9).alias("score"))
