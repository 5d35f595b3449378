"""Prediction sources: classification of paths and URLs, manifests, and media listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.sources.lines import numbered_lines

# File suffixes and URL schemes per kind of source.
IMAGE_SUFFIXES = ("avif", "bmp", "gif", "ico", "jp2", "jpeg", "jpg", "mpo", "png", "tif", "tiff", "webp")
VIDEO_SUFFIXES = ("asf", "avi", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ts", "webm", "wmv")
MANIFEST_SUFFIXES = ("txt", "csv", "streams")
LIVE_SUFFIXES = ("m3u8", "mjpg", "mjpeg")
LIVE_SCHEMES = ("rtsp", "rtsps", "rtmp", "tcp", "udp", "srt")
LABELLED_IMAGE_SUFFIXES = ("bmp", "dng", "jpg", "jpeg", "mpo", "png", "tif", "tiff", "webp")
MANIFEST_HEADERS = ("source", "path")
LARGEST_CAMERA = 2**31 - 1


def suffix(path: Column) -> Column:
    """Lower-case suffix of the last path part without its dot; empty for dot files and names without one."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))


def classify(source: Column, stream_entry: bool = False) -> Column:
    """Kind of a source by its text alone; null for a blank one. Files and folders are not probed."""
    scheme = F.lower(F.regexp_extract(source, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(source, r"^[A-Za-z]+://(?:[^/?#]*@)?([^/?#:]*)", 1))
    url_path = F.regexp_extract(source, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    url_suffix, path_suffix = suffix(url_path), suffix(source)
    is_web = scheme.isin("http", "https")
    youtube = host.isin("youtu.be", "youtube.com") | host.endswith(".youtube.com")
    live_web = url_suffix.isin(*LIVE_SUFFIXES)
    if stream_entry:
        live_web = live_web | ~url_suffix.isin(*IMAGE_SUFFIXES)
    named = (*IMAGE_SUFFIXES, *VIDEO_SUFFIXES, *MANIFEST_SUFFIXES)
    screen = (F.split_part(source, F.lit(" "), F.lit(1)) == "screen") & ~path_suffix.isin(*named)
    camera = source.rlike(r"^[0-9]+$")
    in_range = F.coalesce(source.try_cast("bigint"), F.lit(2**62)) <= LARGEST_CAMERA
    return (
        F.when(F.trim(source) == "", F.lit(None).cast("string"))
        .when(scheme.isin(*LIVE_SCHEMES), F.lit("live"))
        .when(is_web & youtube, F.lit("youtube"))
        .when(is_web & url_suffix.isin(*VIDEO_SUFFIXES), F.lit("http_video"))
        .when(is_web & live_web, F.lit("live"))
        .when(is_web, F.lit("image"))
        .when(camera, F.when(in_range, F.lit("camera")))
        .when(screen, F.lit("screen"))
        .when(source.rlike(r"[*?\[]"), F.lit("glob"))
        .when(path_suffix == "streams", F.lit("streams"))
        .when(path_suffix.isin(*MANIFEST_SUFFIXES), F.lit("manifest"))
        .when(path_suffix.isin(*VIDEO_SUFFIXES), F.lit("video"))
        .when(source.endswith("/"), F.lit("directory"))
        .otherwise(F.lit("image"))
    )


def manifest_entries(lines: DataFrame) -> DataFrame:
    """Entries of manifests given as lines (file_path, line_no, text), blanks and # comments left out.

    In a CSV the first row that holds anything is a header when a cell says "source" or "path"; then only that column
    counts, else every cell does.
    """
    is_csv = suffix(F.col("file_path")) == "csv"
    text = F.regexp_replace("text", "^\ufeff", "")
    # Commas followed by an even number of quotes separate cells; a quoted cell loses its quotes.
    cells = F.transform(
        F.split(text, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'),
        lambda c: F.when(c.rlike(r'^".*"$'), F.regexp_replace(F.substr(c, F.lit(2), F.length(c) - 2), '""', '"')).otherwise(c),
    )
    used = lambda c: c.isNotNull() & (F.trim(c) != "") & ~F.trim(c).startswith("#")
    rows = lines.select(
        "file_path",
        "line_no",
        is_csv.alias("_csv"),
        F.when(is_csv, cells).otherwise(F.array(text)).alias("_cells"),
    ).filter(F.exists("_cells", used))
    first = rows.filter("_csv").groupBy("file_path").agg(
        F.min_by("_cells", "line_no").alias("_header"), F.min("line_no").alias("_first")
    )
    header = F.transform("_header", lambda c: F.lower(F.trim(c)))
    positions = [F.nullif(F.array_position(header, name), F.lit(0)) for name in MANIFEST_HEADERS]
    first = first.select("file_path", "_first", F.least(*positions).alias("_column"))
    joined = rows.join(first, "file_path", "left")
    body = joined.filter(F.col("_column").isNull() | (F.col("line_no") > F.col("_first")))
    chosen = F.when(F.col("_column").isNull(), F.col("_cells")).otherwise(
        F.array(F.get("_cells", (F.col("_column") - 1).cast("int")))
    )
    entries = body.select("file_path", "line_no", F.posexplode(chosen).alias("cell_no", "_cell")).filter(used(F.col("_cell")))
    return entries.select("file_path", "line_no", "cell_no", F.trim("_cell").alias("source"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Entries of manifest files with their kind; relative paths are resolved against the manifest's folder."""
    entries = manifest_entries(numbered_lines(spark, path, "*.{txt,csv,streams}"))
    folder = F.regexp_replace(F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1), r"^file:(//)?", "")
    kind = classify(F.col("source"))
    relative = ~F.col("source").startswith("/") & ~F.col("source").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    resolved = F.when(relative & ~kind.isin("camera", "screen"), F.concat(folder, F.lit("/"), F.col("source")))
    return entries.withColumns({"kind": kind, "resolved": F.coalesce(resolved, F.col("source"))})


def list_media(spark: SparkSession, folder: str, suffixes: Sequence[str] = LABELLED_IMAGE_SUFFIXES) -> DataFrame:
    """Media files of a folder with their size; contents are not read. Resource-fork files (._*) are skipped."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return keep_media(files.withColumn("file_name", F.regexp_extract("path", r"([^/]*)$", 1)), suffixes)


def keep_media(files: DataFrame, suffixes: Sequence[str] = LABELLED_IMAGE_SUFFIXES) -> DataFrame:
    return files.filter(suffix(F.col("file_name")).isin(*suffixes) & ~F.col("file_name").startswith("._"))
