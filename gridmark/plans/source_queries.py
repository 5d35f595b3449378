"""Readers, writers and converters, fed with files or lines that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridmark import scale
from gridmark.operators import keypoints as kp
from gridmark.operators import labels as lb
from gridmark.plans.fixtures import read, view, with_views
from gridmark.plans.registry import query
from gridmark.plans.shard_queries import _PLAN, _planned
from gridmark.sources import coco, lines, media, yolo
from gridmark.sources import tables as tb


@query("coco_documents", with_views(
    """select a.ann_id, a.image_id, i.file_name, a.category_id, a.x, a.y, a.w, a.h, a.area, a.iscrowd, i.split
       from ann a join img i using (image_id)""", "ann", "img"))  # fmt: skip
def coco_documents(spark, folder):
    """Annotations written as published documents of a hundred images each, read back as tables and joined."""
    images = view(spark, folder, "img")
    chunk = F.floor(F.col("image_id") / 100).alias("chunk")
    boxed = view(spark, folder, "ann").join(images.select("image_id", "split"), "image_id")
    image_part = images.groupBy("split", chunk).agg(
        F.collect_list(F.struct(F.col("image_id").alias("id"), "file_name", "width", "height")).alias("images")
    )
    annotation = F.struct(
        F.col("ann_id").alias("id"), "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), "area",
        F.col("iscrowd").cast("int").alias("iscrowd"),
    )
    # Ids are unique, so a range of them bounds a document even when one image holds very many annotations.
    annotation_part = boxed.groupBy("split", F.floor(F.col("ann_id") / 100_000).alias("chunk")).agg(F.collect_list(annotation).alias("annotations"))
    path = scale.run_folder(spark, "coco")
    image_part.join(annotation_part, ["split", "chunk"], "full").write.partitionBy("split").json(path)
    parts = [coco.read_coco(spark, f"{path}/split={name}", name, one_per_line=True) for name in ("train", "val")]
    images = parts[0].images.unionByName(parts[1].images)
    annotations = parts[0].annotations.unionByName(parts[1].annotations)
    joined = annotations.join(images.select("image_id", "file_name"), "image_id")
    return joined.select("ann_id", "image_id", "file_name", "category_id", "x", "y", "w", "h", "area", "iscrowd", "split")


# Objects of one list in a document of many lines: some hundred MB, so that several tasks read it and one can write it.
_DOCUMENT_OBJECTS = 1_000_000
# Documents of a split that are on disk together.
_DOCUMENTS_AT_ONCE = 24


@query("coco_large_documents", with_views(
    """select a.ann_id, a.image_id, i.file_name, a.category_id, a.x, a.y, a.w, a.h, a.area, a.iscrowd, i.split,
         case when a.iscrowd then '{"counts":[' || a.ann_id || ',1],"size":[2,{}]}' else '[[1.0,2.0,3.0]]' end as segmentation
       from ann a join img i using (image_id)""".replace("{}", "3"), "ann", "img"))  # fmt: skip
def coco_large_documents(spark, folder):
    """All annotations of a split as documents of many lines, one for a million objects, read object by object by many tasks.

    Documents are written, read and given up some at a time; all objects of an image are in documents of the same time.
    """
    # Stored, so that rows are numbered once and can be read image by image.
    base = scale.stored(view(spark, folder, "base"), "base")
    images, annotations = view(spark, folder, "img"), view(spark, folder, "ann", base=base)
    splits = scale.stored(images.select("split").distinct(), "splits")
    times = 1 + max(images.count(), annotations.count()) // (_DOCUMENT_OBJECTS * _DOCUMENTS_AT_ONCE)
    return scale.in_parts(times, "image_id", [images, annotations], lambda i, a: _large_documents(spark, i, a, splits), "coco-joined")


def _large_documents(spark, images, annotations, splits):
    boxed = annotations.join(images.select("image_id", "split"), "image_id")
    documents = 1 + max(images.count(), annotations.count()) // _DOCUMENT_OBJECTS
    runs = F.concat(F.lit('{"counts":['), F.col("ann_id").cast("string"), F.lit(',1],"size":[2,3]}'))
    image = F.to_json(F.struct(F.col("image_id").alias("id"), "file_name", "width", "height"))
    annotation = F.to_json(F.struct(
        F.col("ann_id").alias("id"), "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), "area",
        F.col("iscrowd").cast("int").alias("iscrowd"), F.lit("#").alias("segmentation"),
    ))
    shape = F.when(F.col("iscrowd"), runs).otherwise(F.lit("[[1.0, 2.0, 3.0]]"))
    annotation = F.replace(annotation, F.lit('"#"'), shape)
    # Lines in order: heads of the lists (the first object after a comma would be none), then their objects.
    numbers = F.explode(F.sequence(F.lit(0), F.lit(documents - 1))).alias("document")
    heads = splits.select("split", numbers).select("split", "document", F.inline(F.array(
        F.struct(F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("key"), F.lit('{"info": {"by": {"name": "a}b{"}}, "images": [{"id": null}').alias("value")),
        F.struct(F.lit(2).alias("part"), F.lit(None).cast("bigint").alias("key"), F.lit('], "licenses": [], "annotations": [{"id": null}').alias("value")),
        F.struct(F.lit(4).alias("part"), F.lit(None).cast("bigint").alias("key"), F.lit("]}").alias("value")),
    )))
    document = F.pmod(F.xxhash64("value"), F.lit(documents)).cast("int").alias("document")
    objects = [rows.select("split", F.lit(part).alias("part"), F.col(key).alias("key"), F.concat(F.lit("  , "), text).alias("value"))
               .select("split", document, "part", "key", "value")
               for rows, part, key, text in ((images, 1, "image_id", image), (boxed, 3, "ann_id", annotation))]
    path = scale.run_folder(spark, "coco-large")
    # A document is written by one task, line by line; a producer's file is what it is.
    lines = heads.unionByName(objects[0]).unionByName(objects[1]).repartition("split", "document")
    lines = lines.sortWithinPartitions("split", "document", "part", "key").select("split", "document", "value")
    with scale.shuffles_released(spark):
        lines.write.partitionBy("split", "document").text(path)
    tables = [coco.read_coco_objects(spark, f"{path}/split={name}", name) for name in ("train", "val")]
    images = tables[0].images.unionByName(tables[1].images).filter("image_id IS NOT NULL")
    annotations = tables[0].annotations.unionByName(tables[1].annotations).filter("ann_id IS NOT NULL")
    joined = annotations.join(images.select("image_id", "file_name"), "image_id")
    return joined.select("ann_id", "image_id", "file_name", "category_id", "x", "y", "w", "h", "area", "iscrowd", "split", "segmentation")


# Label lines of several shapes: box, polygon, odd polygon, bad class, bad number, NaN, too few fields.
_LINES = """
    lines as (select image_id, rn as line_no, case rn % 7
      when 1 then '2 0.1 0.2 0.7' || f || ' 0.25 0.' || n || ' 0.95'
      when 2 then '1 0.1 0.2 0.7 0.25 0.' || n
      when 3 then (case when l_linenumber > 3 then '9' else 'x1' end) || ' 0.5 0.5 0.2 0.2'
      when 4 then '0 0.5 0.5 0.2 ' || (case when l_linenumber > 3 then 'wide' else 'nan' end)
      when 5 then '0 0.5 0.5'
      else (l_linenumber % 3) || ' 0.' || n || ' 0.4' || n || ' 0.' || f || '5 0.3' end as text, n, f, l_linenumber
      from (select *, lpad(cast(l_partkey % 1000 as varchar), 3, '0') as n, cast(l_suppkey % 10 as varchar) as f from base))
"""


def _lines(spark, folder):
    n = F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")
    f = (F.col("l_suppkey") % 10).cast("string")
    late = F.col("l_linenumber") > 3
    lit = F.lit
    text = (
        F.when(F.col("rn") % 7 == 1, F.concat(lit("2 0.1 0.2 0.7"), f, lit(" 0.25 0."), n, lit(" 0.95")))
        .when(F.col("rn") % 7 == 2, F.concat(lit("1 0.1 0.2 0.7 0.25 0."), n))
        .when(F.col("rn") % 7 == 3, F.concat(F.when(late, lit("9")).otherwise(lit("x1")), lit(" 0.5 0.5 0.2 0.2")))
        .when(F.col("rn") % 7 == 4, F.concat(lit("0 0.5 0.5 0.2 "), F.when(late, lit("wide")).otherwise(lit("nan"))))
        .when(F.col("rn") % 7 == 5, lit("0 0.5 0.5"))
        .otherwise(F.concat((F.col("l_linenumber") % 3).cast("string"), lit(" 0."), n, lit(" 0.4"), n, lit(" 0."), f, lit("5 0.3")))
    )
    return view(spark, folder, "base").select("image_id", F.col("rn").cast("long").alias("line_no"), text.alias("text"))


@query("label_files", with_views(
    f"""with {_LINES} select case when (image_id // 50) % 4 = 3 then 'val' else 'train' end as split, 'sheet_' || (image_id // 50) as stem,
          (row_number() over (partition by image_id // 50 order by image_id, line_no))::int as line_no, text from lines""", "base"))  # fmt: skip
def label_files(spark, folder):
    """Label lines written as files under the names of their images, fifty images on a sheet, and read by their places."""
    sheet = F.floor(F.col("image_id") / 50)
    split = F.when(sheet % 4 == 3, F.lit("val")).otherwise(F.lit("train"))
    name = F.concat(split, F.lit("/labels/sheet_"), sheet.cast("string"), F.lit(".txt"))
    rows = _lines(spark, folder).select(name.alias("name"), F.struct("image_id", "line_no").alias("line_no"), "text")
    number = F.row_number().over(Window.partitionBy("name").orderBy("line_no"))
    path = scale.run_folder(spark, "labels")
    lines.write_files(rows.withColumn("line_no", number), path)
    return yolo.read_label_lines(spark, path)


_PARSED = f"""
    {_LINES},
    v as (select l.*, width::float as wf, height::float as hf, width, height, string_split(text, ' ') as p
          from lines l join img using (image_id)),
    parsed as (select image_id, line_no, width, height, case line_no % 7 when 2 then 'odd coordinate count'
        when 3 then (case when l_linenumber > 3 then 'class id out of range' else 'invalid class id' end)
        when 4 then (case when l_linenumber > 3 then 'malformed number' else 'non-finite coordinates' end)
        when 5 then 'too few fields' end as reason,
      try_cast(p[1] as bigint) as label,
      case when line_no % 7 in (0, 6) then [(p[2]::double - p[4]::double/2)::float*wf, (p[3]::double - p[5]::double/2)::float*hf,
          (p[2]::double + p[4]::double/2)::float*wf, (p[3]::double + p[5]::double/2)::float*hf]
        when line_no % 7 = 1 then [least(p[2]::float, p[4]::float, p[6]::float)*wf, least(p[3]::float, p[5]::float, p[7]::float)*hf,
          greatest(p[2]::float, p[4]::float, p[6]::float)*wf, greatest(p[3]::float, p[5]::float, p[7]::float)*hf] end as b,
      case when line_no % 7 = 1 then least(greatest((p[6]::float*wf)::double, 0), width - 1) end as px,
      case when line_no % 7 = 1 then least(greatest((p[7]::float*hf)::double, 0), height - 1) end as py from v)
"""


def _parsed(spark, folder):
    sized = _lines(spark, folder).join(view(spark, folder, "img"), "image_id")
    return yolo.parse_lines(sized, 3)


@query("parse_label_lines", with_views(
    f"""with {_PARSED} select image_id, line_no, case when reason is null then label end as label, reason,
          case when reason is null then b[1]::double end as x1, case when reason is null then b[2]::double end as y1,
          case when reason is null then b[3]::double end as x2, case when reason is null then b[4]::double end as y2,
          px, py from parsed""", "base", "img"))  # fmt: skip
def parse_label_lines(spark, folder):
    fine = F.col("reason").isNull()
    polygon = F.when(F.col("line_no") % 7 == 1, F.col("polygon"))
    return _parsed(spark, folder).select(
        "image_id", "line_no", F.when(fine, F.col("label")).alias("label"), "reason",
        *[F.when(fine, F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")],
        F.get(polygon, 4).alias("px"), F.get(polygon, 5).alias("py"),
    )


@query("labels_to_coco", with_views(
    f"""with {_PARSED}, good as (select i.file_name, p.* from parsed p join img i using (image_id) where reason is null),
        numbered as (select file_name, row_number() over (order by file_name) - 1 as image_id from img),
        o as (select n.image_id, g.line_no, g.label, g.b[1]::double as x, g.b[2]::double as y, g.b[3]::double - g.b[1]::double as w,
                g.b[4]::double - g.b[2]::double as h from good g join numbered n using (file_name))
        select row_number() over (order by image_id, line_no) - 1 as ann_id, image_id, label as category_id, x, y, w, h, w*h as area,
          false as iscrowd from o""", "base", "img"))  # fmt: skip
def labels_to_coco(spark, folder):
    good = _parsed(spark, folder).filter("reason IS NULL")
    names = read(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("label"), F.col("n_name").alias("name"))
    return yolo.to_coco(view(spark, folder, "img"), good, names)[1]


@query("images_with_label_lines", with_views(
    f"""with {_LINES} select i.image_id, count(l.text) as objects from img i left join
        lines l using (image_id) group by 1""", "base", "img"))  # fmt: skip
def images_with_label_lines(spark, folder):
    stem = F.concat(F.lit("img_"), F.col("image_id").cast("string"))
    split = view(spark, folder, "img").select("image_id", "split")
    lines = _lines(spark, folder).join(split, "image_id").select("split", stem.alias("stem"), "line_no", "text")
    joined = yolo.join_images(view(spark, folder, "img"), lines)
    return joined.groupBy("image_id").agg(F.count("text").alias("objects"))


@query("parse_pose_lines", with_views(
    """with p as (select image_id, rn as line_no, l_linenumber, width, height, lpad(cast(l_partkey % 1000 as varchar), 3, '0') as n
                  from base join img using (image_id))
       select image_id, line_no, case when l_linenumber = 7 then 'wrong field count' when l_linenumber = 6 then 'visibility out of range' end as reason,
         case when l_linenumber < 6 then (('0.' || n)::float * width::float)::double end as kx0,
         case when l_linenumber < 6 then (0.25::float * height::float)::double end as ky0,
         case when l_linenumber < 6 then 2.0::double end as kv0,
         case when l_linenumber >= 6 then null when l_linenumber % 3 = 0 then 0 else (1::float * width::float)::double end as kx1,
         case when l_linenumber < 6 then (l_linenumber % 3)::double end as kv1 from p""", "base", "img"))  # fmt: skip
def parse_pose_lines(spark, folder):
    """Points of three numbers."""
    number = F.col("l_linenumber")
    n = F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")
    visibility = F.when(number == 6, F.lit("3")).otherwise((number % 3).cast("string"))
    text = F.concat(F.lit("0 0.5 0.5 0.5 0.5 0."), n, F.lit(" 0.25 2 1.5 0.5 "), visibility)
    text = F.when(number == 7, F.concat(text, F.lit(" 1"))).otherwise(text)
    lines = view(spark, folder, "base").select("image_id", F.col("rn").cast("long").alias("line_no"), text.alias("text"))
    parsed = yolo.parse_pose_lines(lines.join(view(spark, folder, "img"), "image_id"), 1, 2, 3)
    points = {"kx0": 0, "ky0": 1, "kv0": 2, "kx1": 3, "kv1": 5}
    return parsed.select(
        "image_id", "line_no", "reason", *[F.get("keypoints", i).alias(name) for name, i in points.items()]
    )


@query("parse_flat_pose_lines", with_views(
    """with p as (select image_id, rn as line_no, l_linenumber, width, height, lpad(cast(l_partkey % 1000 as varchar), 3, '0') as n
                  from base join img using (image_id)),
       q as (select *, case l_linenumber % 3 when 0 then '-0.5' when 1 then '0' else '1.5' end as x1, case l_linenumber % 3 when 1 then 0 else 0.5 end as y1 from p)
       select image_id, line_no, case when l_linenumber = 7 then 'wrong field count' when l_linenumber = 6 then 'malformed number' end as reason,
         case when l_linenumber < 6 then case when n = '000' then 0 else (('0.' || n)::float * width::float)::double end end as kx0,
         case when l_linenumber < 6 then case when n = '000' then 0 else 2 end::double end as kv0,
         case when l_linenumber < 6 then case when l_linenumber % 3 = 2 then (1::float * width::float)::double else 0 end end as kx1,
         case when l_linenumber < 6 then case when l_linenumber % 3 = 2 then (0.5::float * height::float)::double else 0 end end as ky1,
         case when l_linenumber < 6 then case when l_linenumber % 3 = 2 then 2 else 0 end::double end as kv1 from q""", "base", "img"))  # fmt: skip
def parse_flat_pose_lines(spark, folder):
    """Points of two numbers: negative ones and the origin are absent, those beyond the image are clamped."""
    number = F.col("l_linenumber")
    n = F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")
    second = F.when(number % 3 == 0, F.lit("-0.5 0.5")).when(number % 3 == 1, F.lit("0 0")).otherwise(F.lit("1.5 0.5"))
    second = F.when(number == 6, F.lit("far 0.5")).when(number == 7, F.lit("0.5")).otherwise(second)
    text = F.concat(F.lit("0 0.5 0.5 0.5 0.5 0."), n, F.lit(" 0 "), second)
    rows = view(spark, folder, "base").select("image_id", F.col("rn").cast("long").alias("line_no"), text.alias("text"))
    parsed = yolo.parse_pose_lines(rows.join(view(spark, folder, "img"), "image_id"), 1, 2, 2)
    points = {"kx0": 0, "kv0": 2, "kx1": 3, "ky1": 4, "kv1": 5}
    return parsed.select("image_id", "line_no", "reason", *[F.get("keypoints", i).alias(name) for name, i in points.items()])


@query("classify_sources", """
    with s as (select page_id, url, case page_id % 12 when 0 then regexp_replace(url, '^https?', 'rtsp') when 1 then 'https://youtu.be/' || page_id
        when 2 then 'https://WWW.YouTube.com/watch?v=' || page_id when 3 then 'http://h.example.org/a/clip.MP4?x=1' || page_id
        when 4 then 'https://h.example.org/live/' || page_id || '.m3u8#t' when 5 then page_id::varchar when 6 then 'screen ' || page_id
        when 7 then 'data/*/' || page_id || '.jpg' when 8 then 'lists/' || page_id || '.csv' when 9 then 'cams/' || page_id || '.streams'
        when 10 then 'clips/' || page_id || '.MOV' else url end as source from pages)
    select page_id, source, case page_id % 12 when 0 then 'live' when 1 then 'youtube' when 2 then 'youtube' when 3 then 'http_video' when 4 then 'live'
      when 5 then 'camera' when 6 then 'screen' when 7 then 'glob' when 8 then 'manifest' when 9 then 'streams' when 10 then 'video' else 'image' end as kind
    from s""")  # fmt: skip
def classify_sources(spark, folder):
    page, lit = F.col("page_id").cast("string"), F.lit
    shapes = [
        F.regexp_replace("url", "^https?", "rtsp"), F.concat(lit("https://youtu.be/"), page),
        F.concat(lit("https://WWW.YouTube.com/watch?v="), page), F.concat(lit("http://h.example.org/a/clip.MP4?x=1"), page),
        F.concat(lit("https://h.example.org/live/"), page, lit(".m3u8#t")), page, F.concat(lit("screen "), page),
        F.concat(lit("data/*/"), page, lit(".jpg")), F.concat(lit("lists/"), page, lit(".csv")),
        F.concat(lit("cams/"), page, lit(".streams")), F.concat(lit("clips/"), page, lit(".MOV")),
    ]
    source = F.col("url")
    for position, shape in enumerate(shapes):
        source = F.when(F.col("page_id") % 12 == position, shape).otherwise(source)
    rows = read(spark, folder, "pages").select("page_id", source.alias("source"))
    return rows.select("page_id", "source", media.classify(F.col("source")).alias("kind"))


@query("manifest_entries", """
    with m as (select page_id, (page_id // 20) as f, page_id % 20 as line_no, url from pages),
    k as (select 'm' || f || (case f % 3 when 0 then '.txt' else '.csv' end) as file_path, f % 3 as kind, line_no, url from m where line_no % 5 <> 4)
    select file_path, line_no::int as line_no, c::int as cell_no, case when c = 0 and kind <> 1 then url when kind = 1 then url else 'b.jpg' end as source
    from (select *, unnest(case kind when 2 then [0, 1] else [0] end) as c from k) where not (kind = 1 and line_no = 0)""")  # fmt: skip
def manifest_entries(spark, folder):
    """Text manifests, CSV manifests whose header names the source column, and CSV manifests without a header."""
    entries = media.manifest_entries(_manifest_lines(spark, folder))
    # A chosen column is reported as cell 0, like a text line.
    return entries.select("file_path", "line_no", "cell_no", "source")


def _manifest_lines(spark, folder):
    number = F.floor(F.col("page_id") / 20)
    line = (F.col("page_id") % 20).cast("int")
    kind = number % 3
    comment = line % 5 == 4
    body = (
        F.when(kind == 0, F.concat(F.lit("  "), F.col("url")))
        .when((kind == 1) & (line == 0), F.lit("name, Source ,size"))
        .when(kind == 1, F.concat(F.lit('a.jpg,"'), F.col("url"), F.lit('",3')))
        .otherwise(F.concat(F.col("url"), F.lit(", b.jpg")))
    )
    suffix = F.when(kind == 0, F.lit(".txt")).otherwise(F.lit(".csv"))
    return read(spark, folder, "pages").select(
        F.concat(F.lit("m"), number.cast("string"), suffix).alias("file_path"), line.alias("line_no"),
        F.when(comment, F.lit("# note")).otherwise(body).alias("text"),
    )


@query("manifest_files", """
    with m as (select page_id, (page_id // 20) as f, page_id % 20 as line_no, url from pages),
    k as (select 'm' || f || (case f % 3 when 0 then '.txt' else '.csv' end) as name, f % 3 as kind, line_no, url from m where line_no % 5 <> 4),
    e as (select name, line_no::int as line_no, c::int as cell_no, case when c = 0 then url else 'b.jpg' end as source
      from (select *, unnest(case kind when 2 then [0, 1] else [0] end) as c from k) where not (kind = 1 and line_no = 0))
    select *, 'image' as kind, case when source = 'b.jpg' then 'lists/b.jpg' else source end as place from e""")  # fmt: skip
def manifest_files(spark, folder):
    """The same manifests as files, read by many tasks; what they name lies beside them or is absolute."""
    path = scale.run_folder(spark, "manifests")
    lines.write_files(_manifest_lines(spark, folder).withColumn("name", F.concat(F.lit("lists/"), "file_path")), path)
    entries = media.read_manifests(spark, path)
    return entries.select(
        F.regexp_extract("file_path", r"([^/]+)$", 1).alias("name"), "line_no", "cell_no", "source", "kind",
        F.regexp_replace("resolved", r"^/.*/(lists/[^/]+)$", "$1").alias("place"),
    )


@query("media_listing", """
    select 'page_' || page_id || case page_id % 3 when 0 then '.jpg' else '.PNG' end as file_name, octet_length(encode(html)) + 1 as length
    from pages where page_id % 4 <> 3""")  # fmt: skip
def media_listing(spark, folder):
    """Files of four kinds on disk, of which the listing keeps the images; sizes come with it, contents are not read."""
    number = F.col("page_id")
    suffix = F.when(number % 4 == 3, F.lit(".tga")).when(number % 3 == 0, F.lit(".jpg")).otherwise(F.lit(".PNG"))
    path = scale.run_folder(spark, "media")
    rows = read(spark, folder, "pages").select(
        F.concat(F.lit("page_"), number.cast("string"), suffix).alias("name"), F.lit(0).alias("line_no"), F.col("html").alias("text")
    )
    lines.write_files(rows, path)
    return media.list_media(spark, path).select("file_name", "length")


@query("daily_counts_file", """
    select ts::date as day, count(*) as downloads from events group by 1""")  # fmt: skip
def daily_counts_file(spark, folder):
    """Daily counts as a CSV table, checked as a whole when it is read."""
    path = scale.run_folder(spark, "daily")
    daily = read(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("downloads"))
    daily.select("day", F.lit("without_mirrors").alias("category"), "downloads").write.option("header", True).csv(path)
    return tb.read_daily_counts(spark, path).select("day", "downloads")


@query("media_files", with_views("select image_id, file_name from img where not file_name like '%.tga'", "img"))
def media_files(spark, folder):
    return media.keep_media(view(spark, folder, "img")).select("image_id", "file_name")


@query("coco_box_records", with_views(
    """select image_id, label * 3 + 1 as category_id, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h, score from det where label <> 2""",
    "det"))
def coco_box_records(spark, folder):
    """Labels 0 and 1 map to known categories; 2 does not and is dropped. Written as JSON lines and read back."""
    categories = view(spark, folder, "cat").filter("category_id < 7")
    space = lb.label_space(view(spark, folder, "cat"))
    path = scale.run_folder(spark, "records")
    coco.write_records(coco.box_records(view(spark, folder, "det"), categories, space), path)
    rows = spark.read.schema("image_id bigint, category_id bigint, bbox array<double>, score double").json(path)
    return rows.select(
        "image_id", "category_id", *[F.get("bbox", i).alias(n) for i, n in enumerate(("x", "y", "w", "h"))], "score"
    )


@query("coco_keypoint_records", with_views(
    """select image_id, label as category_id, case label when 0 then 3 when 1 then 6 else 9 end::int as numbers, x1 as first,
         case label when 0 then x1 + 2 when 1 then x1 + 5 else det_idx::double end as last, score from det""", "det"))  # fmt: skip
def coco_keypoint_records(spark, folder):
    detections = view(spark, folder, "det").withColumn(
        "keypoints", F.array(*[F.col("x1") + i for i in range(8)], F.col("det_idx").cast("double"))
    )
    annotations = view(spark, folder, "gt").filter("label < 2").select(
        F.col("label").alias("category_id"), F.array_repeat(F.lit(1.0), ((F.col("label") + 1) * 3).cast("int")).alias("keypoints")
    )
    categories = view(spark, folder, "gt").select(F.col("label").alias("category_id")).distinct()
    declared = categories.withColumn("keypoints", F.lit(None).cast("array<string>"))
    rows = coco.keypoint_records(detections, kp.keypoint_counts(declared, annotations), categories)
    return rows.select(
        "image_id", "category_id", F.size("keypoints").alias("numbers"), F.get("keypoints", 0).alias("first"),
        F.element_at("keypoints", -1).alias("last"), "score",
    )


@query("written_shards", f"""
    with {_PLAN} select split, shard_id, samples, bytes, digest, samples as stored from shards""")  # fmt: skip
def written_shards(spark, folder):
    """Shards and index on disk: the index's counts next to the rows really stored in each shard."""
    planned = _planned(spark, folder)
    index = tb.shard_index(planned, ["position", "payload_bytes", "lang"])
    path = scale.run_folder(spark, "shards")
    tb.write_shards(planned, index, path)
    rows = tb.read_shard_index(spark, path, "train").unionByName(tb.read_shard_index(spark, path, "val"))
    stored = spark.read.parquet(f"{path}/shards").groupBy("split", F.col("shard_id").cast("long").alias("shard_id"))
    joined = rows.join(stored.agg(F.count("*").alias("stored")), ["split", "shard_id"])
    return joined.select("split", "shard_id", "samples", "bytes", "digest", "stored")


@query("metrics_of_runs", """
    select event_type as run, day(ts)::int as epoch, 'loss' as metric, value from events
    union all select event_type, day(ts)::int, 'mAP', value + 1 from events""")  # fmt: skip
def metrics_of_runs(spark, folder):
    """One run per event type; runs have their columns in different orders, and each file is read by its own header."""
    path = scale.run_folder(spark, "runs")
    events = read(spark, folder, "events")
    columns = [F.dayofmonth("ts").alias("epoch"), F.col("value").alias("train/loss"), (F.col("value") + 1).alias("val/mAP")]
    for number, (name,) in enumerate(sorted(events.select("event_type").distinct().collect())):
        turned = columns[number % 3 :] + columns[: number % 3]
        events.filter(F.col("event_type") == name).select(*turned).write.option("header", True).csv(f"{path}/{name}")
    return tb.read_metrics(spark, path).select("run", "epoch", "metric", "value")


@query("metrics_file", """
    select day(ts)::int as epoch, event_id::int as step, 'train' as split, 'loss' as metric, value from events where event_type <> 'view'
    union all select day(ts)::int, event_id::int, 'val', 'mAP', value from events where event_type = 'view'""")  # fmt: skip
def metrics_file(spark, folder):
    path = scale.run_folder(spark, "metrics")
    wide = read(spark, folder, "events").select(
        F.dayofmonth("ts").alias("epoch"), F.col("event_id").alias("step"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("train/loss"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("val/mAP"),
    )
    wide.write.option("header", True).csv(path)
    return tb.read_metrics(spark, path).select("epoch", "step", "split", "metric", "value")
