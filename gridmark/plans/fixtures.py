"""Detection tables derived from the driver's tables by SQL that both engines understand.

Each text names its inputs in braces. Spark fills them with DataFrames, the oracle with the names of common table
expressions, so both sides start from the same definition. ``{A}`` builds an array and ``{E}`` takes its n-th element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# (l_orderkey, l_linenumber) repeats, so rows of an image are numbered over every column.
_VIEWS: dict[str, str] = {
    "base": """
        select l_orderkey as image_id,
               row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity,
                 l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 as rn,
               l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax
        from {lineitem}""",
    "gt": """
        select image_id, cast(rn as bigint) as gt_idx, l_partkey % 3 as label,
               cast((l_partkey*7)%60 as double) as x1, cast((l_suppkey*11)%60 as double) as y1,
               cast((l_partkey*7)%60 + 20 + (l_partkey%3)*10 as double) as x2,
               cast((l_suppkey*11)%60 + 20 + (l_suppkey%3)*10 as double) as y2,
               rn % 7 = 6 as iscrowd
        from {base} where l_linenumber <> 1""",
    "det": """
        select image_id, cast(rn as bigint) as det_idx,
               case when l_linenumber = 7 then (l_partkey+1)%3 else l_partkey%3 end as label,
               (cast(round(l_discount*100) as int)*9 + l_linenumber) / cast(100 as double) as score,
               cast((l_partkey*7)%60 + l_linenumber as double) as x1, cast((l_suppkey*11)%60 as double) as y1,
               cast((l_partkey*7)%60 + l_linenumber + 20 + (l_partkey%3)*10 as double) as x2,
               cast((l_suppkey*11)%60 + 20 + (l_suppkey%3)*10 as double) as y2
        from {base} where l_tax > 0""",
    "img": """
        select o_orderkey as image_id,
               concat('shelf_', cast(o_custkey % 7 as string), '/img_', cast(o_orderkey as string),
                 case o_orderkey % 11 when 3 then '.PNG' when 5 then '.tga' else '.jpg' end) as file_name,
               cast(90 + o_orderkey % 21 as int) as width, cast(95 + o_custkey % 16 as int) as height,
               case when o_orderkey % 5 = 4 then 'val' else 'train' end as split
        from {orders}""",
    # Annotations as published: x, y, w, h boxes, partly outside the image and partly empty.
    "ann": """
        select image_id * 1000 + rn as ann_id, image_id, (l_partkey % 5) * 3 + 1 as category_id,
               cast((l_partkey*7)%90 as double) - 5.5 as x, cast((l_suppkey*11)%90 as double) - 5.25 as y,
               l_quantity - 4.0 as w, cast(l_linenumber*9 - 9 as double) as h,
               (l_quantity - 4.0) * 8.5 as area, rn % 9 = 8 as iscrowd
        from {base}""",
    # Corner targets with three keypoints, inside images.
    "target": """
        select b.image_id, cast(b.rn as bigint) as gt_idx, b.l_partkey % 3 as label,
               cast((b.l_partkey*7)%60 as double) as x1, cast((b.l_suppkey*11)%60 as double) as y1,
               cast((b.l_partkey*7)%60 + 20 + (b.l_partkey%3)*10 as double) as x2,
               cast((b.l_suppkey*11)%60 + 20 + (b.l_suppkey%3)*10 as double) as y2,
               cast(100 + (b.l_partkey*13)%900 as double) as area, i.width, i.height,
               {A}(cast((b.l_partkey*5)%130 as double), cast((b.l_suppkey*3)%120 as double), cast(b.rn % 3 as double),
                 cast((b.l_partkey*3)%100 as double), cast((b.l_suppkey*7)%100 as double), 2.0D,
                 cast((b.l_partkey*11)%140 as double), cast((b.l_suppkey*5)%90 as double),
                 cast(b.l_linenumber % 2 as double)) as keypoints
        from {base} b join {img} i on b.image_id = i.image_id""",
    "cat": """
        select cast(n_nationkey * 3 + 1 as bigint) as category_id, n_name as name,
               case when n_nationkey % 4 = 1 then 'NATION_0' when n_nationkey % 4 = 2 then 'NATION_5'
                    when n_nationkey % 4 = 3 then 'none' else n_name end as supercategory
        from {nation}""",
    # Ten queries per image; the first eight entries of the vector are class logits.
    "raw": """
        select cast((vec_id - vec_id % 10) / 10 as bigint) as image_id, cast(vec_id % 10 as int) as query_idx,
               embedding,
               {A}({logits}) as logits,
               0.5D + cast({E}(embedding, 21) as double) as cx, 0.5D + cast({E}(embedding, 22) as double) as cy,
               0.2D + cast({E}(embedding, 23) as double) as w, 0.3D + cast({E}(embedding, 24) as double) as h
        from {embeddings}""",
}
_LOGITS = ", ".join(f"cast({{E}}(embedding, {i}) as double)" for i in range(1, 9))


def _inputs(text: str) -> list[str]:
    return [n for n in (*_VIEWS, *TABLES) if "{" + n + "}" in text]


def _text(name: str, array: str, element: str) -> str:
    text = _VIEWS[name].replace("{logits}", _LOGITS)
    return text.replace("{A}", array).replace("{E}", element)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def view(spark: SparkSession, folder: str, name: str, **tables: DataFrame) -> DataFrame:
    """A derived table as a DataFrame; *tables* stand for the stored or derived tables of their names."""
    if name in tables:
        return tables[name]
    if name in TABLES:
        return read(spark, folder, name)
    text = _text(name, "array", "element_at")
    return spark.sql(text, **{n: view(spark, folder, n, **tables) for n in _inputs(text)})


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """Put the common table expressions of *names* and what they need in front of *sql*."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for needed in _inputs(_VIEWS[name]):
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    parts = []
    for name in ordered:
        text = _text(name, "list_value", "list_extract").replace("0D", "0::double").replace("5D", "5::double")
        text = text.replace("2D", "2::double").replace("3D", "3::double")
        for needed in _inputs(text):
            text = text.replace("{" + needed + "}", needed)
        parts.append(f"{name} as ({text})")
    body = sql.strip()
    lead = "with recursive " if recursive else "with "
    if body.lower().startswith("with "):
        body = body[5:] if not body.lower().startswith("with recursive ") else body[15:]
        return lead + ",\n".join(parts) + ",\n" + body
    return lead + ",\n".join(parts) + "\n" + body
