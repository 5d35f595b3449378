"""Objects of large JSON documents, each document read by many tasks.

A published annotation file is one JSON object with a few long lists of objects. Spark's text reader cuts it by byte range
at closing braces, wherever these stand. What a piece means depends on what is before it: whether it starts inside a string,
and how deep. Both are running sums, of quotes and of brackets. Inside a byte range they are taken for either case of the
start; ranges then add up to the start of each, one row per range. A piece that ends two levels deep ends an object of a
list, so pieces up to there make one object; most objects are a single piece and are never shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmark import scale

_BLOCK = ["_file", "_block"]
# A key of the document whose value is an object, or a list that begins with one.
_CONTAINER = r'"([^"]*)"\s*:\s*(\[\s*\{|\{)'
_FIRST_OBJECT = r'(?s)"(?:[^"\\]|\\.)*"\s*:\s*\[\s*(\{.*)'
_NEXT_OBJECT = r"(?s)^[^{]*(\{.*)"


def _number(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _plain() -> Column:
    """The text of a piece without escape pairs."""
    return F.regexp_replace("value", r"(?s)\\.", "")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between closing braces, with quotes, and the rise in depth for a start outside (0) and inside (1) a string."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
    )
    # No escape pair is cut: a backslash never stands before a brace.
    # Generated instead of projected, here and below, so that what uses it does not compute it again.
    parts = raw.select("*", F.explode(F.array(F.split(_plain(), '"'))).alias("_parts"))
    # Every second part is outside strings, for either case of the first one.
    parts = parts.withColumn("_out", F.array_join(F.filter("_parts", lambda p, i: i % 2 == 0), " "))
    parts = parts.withColumn("_in", F.array_join(F.filter("_parts", lambda p, i: i % 2 == 1), " "))
    quotes = F.size("_parts") - 1
    # The closing brace itself counts where the piece ends outside a string.
    rises = [
        _number(F.col(name), "{[") - _number(F.col(name), "]") - F.when((quotes + start) % 2 == 0, 1).otherwise(0)
        for start, name in enumerate(("_out", "_in"))
    ]
    firsts = [F.regexp_extract(name, r"[\[\]{]", 0).alias(f"_first{start}") for start, name in enumerate(("_out", "_in"))]
    return parts.select(
        *_BLOCK, "_pos", "value", quotes.alias("_quotes"), rises[0].alias("_rise0"), rises[1].alias("_rise1"), *firsts
    )


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Pieces with their depth at start and end, whether no string is open at the end, and their first bracket."""
    inside = Window.partitionBy(*_BLOCK).orderBy("_pos")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)

    def so_far(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(before), F.lit(0))

    # Both cases of a range's start, followed through the range.
    followed = _pieces(spark, path).withColumn("_open", so_far(F.col("_quotes")) % 2)
    same, other = F.col("_rise0"), F.col("_rise1")
    for case in (0, 1):
        followed = followed.withColumn(f"_step{case}", F.when(F.col("_open") == case, same).otherwise(other))
    followed = followed.withColumns({f"_depth{case}": so_far(F.col(f"_step{case}")) for case in (0, 1)})
    followed = scale.stored(followed.drop("_rise0", "_rise1"), "json-pieces")

    totals = followed.groupBy(*_BLOCK).agg(
        (F.sum("_quotes") % 2).alias("_turn"), F.sum("_step0").alias("_sum0"), F.sum("_step1").alias("_sum1")
    )
    # One row per byte range of a file.
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_case", F.coalesce(F.sum("_turn").over(earlier), F.lit(0)) % 2)
    gained = F.when(F.col("_case") == 0, F.col("_sum0")).otherwise(F.col("_sum1"))
    starts = starts.withColumn("_base", F.coalesce(F.sum(gained).over(earlier), F.lit(0)))
    # So few that they go to the pieces, which stay where they are and are stored once.
    starts = scale.stored(starts.select(*_BLOCK, "_case", "_base"), "json-ranges")
    known = followed.join(F.broadcast(starts), _BLOCK)
    first = F.col("_case") == 0
    depth = F.col("_base") + F.when(first, F.col("_depth0")).otherwise(F.col("_depth1"))
    end = depth + F.when(first, F.col("_step0")).otherwise(F.col("_step1"))
    quoted = (F.col("_case") + F.col("_open")) % 2
    closed = (quoted + F.col("_quotes")) % 2 == 0
    bracket = F.when(quoted == 0, F.col("_first0")).otherwise(F.col("_first1"))
    return known.select(
        *_BLOCK, "_pos", "value", depth.alias("_from"), end.alias("_to"), closed.alias("_closed"), bracket.alias("_bracket")
    )


def document_objects(spark: SparkSession, path: str) -> DataFrame:
    """``file, section, text``: every object of every top-level list of objects of the JSON documents at *path*.

    Top-level keys that hold an object are bookmarks only; a document has a handful of them, and their list is broadcast to
    its pieces, which a shuffle by document would gather in one task. Names with a leading underscore are not listed by Spark.
    """
    placed = _placed(spark, path)
    at = F.struct("_block", "_pos")
    # A piece that starts at the top, or closes a list there, says what follows: the list of objects or the object that its
    # first brace opens, or nothing of that kind.
    at_top = (F.col("_from") <= 1) | ((F.col("_from") == 2) & (F.col("_bracket") == "]"))
    top = placed.filter(at_top).withColumn("_plain", _plain())
    opens_list = F.regexp_extract("_plain", _CONTAINER, 2).startswith("[")
    section = F.when(opens_list, F.regexp_extract("_plain", _CONTAINER, 1))
    marks = top.select("_file", F.struct(at.alias("at"), section.alias("section")).alias("mark"))
    marks = marks.groupBy("_file").agg(F.sort_array(F.collect_list("mark")).alias("_marks"))
    named = placed.join(F.broadcast(marks), "_file").withColumn("_at", at)
    mark = F.try_element_at(F.filter("_marks", lambda m: m["at"] <= F.col("_at")), F.lit(-1))
    named = named.select("*", F.explode(F.array(mark["section"])).alias("section")).filter(F.col("section").isNotNull())

    starts, ends = F.col("_from") <= 2, F.col("_closed") & (F.col("_to") == 2)
    text = (
        F.when(at_top, F.regexp_extract("value", _FIRST_OBJECT, 1))
        .when(F.col("_from") == 2, F.regexp_extract("value", _NEXT_OBJECT, 1))
        .otherwise(F.col("value"))
    )
    # Closing the list or what follows it opens no object; other pieces get back the brace that cut them.
    text = F.explode(F.array(F.concat(text, F.lit("}")))).alias("text")
    shown = named.select(*_BLOCK, "_pos", "section", starts.alias("_starts"), ends.alias("_ends"), text)
    shown = shown.filter(~F.col("_starts") | (F.length("text") > 1))
    whole = shown.filter(F.col("_starts") & F.col("_ends")).select(F.col("_file").alias("file"), "section", "text")

    # Objects of several pieces: numbered by the ends before them, inside ranges and then over ranges.
    several = shown.filter(~(F.col("_starts") & F.col("_ends")))
    ended = F.col("_ends").cast("bigint")
    inside = Window.partitionBy(*_BLOCK).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    counted = several.withColumn("_nth", F.coalesce(F.sum(ended).over(inside), F.lit(0)))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = several.groupBy(*_BLOCK).agg(F.sum(ended).alias("_here"))
    blocks = blocks.select(*_BLOCK, F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_before"))
    numbered = counted.join(blocks, _BLOCK).withColumn("_nth", F.col("_nth") + F.col("_before"))
    piece = F.struct("_block", "_pos", "text", "_ends")
    gathered = numbered.groupBy("_file", "section", "_nth").agg(F.sort_array(F.collect_list(piece)).alias("_all"))
    # What follows the last object of a section opens none and ends none.
    gathered = gathered.filter(F.element_at("_all", -1)["_ends"])
    joined = F.array_join(F.transform("_all", lambda p: p["text"]), "")
    return whole.unionByName(gathered.select(F.col("_file").alias("file"), "section", joined.alias("text")))
