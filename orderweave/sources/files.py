"""File listings: paths, directories, media types, sizes, stored names."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderweave import fixed_values as fv
from orderweave.functions.text import lookup, strip


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, modified)`` of all files below a folder, contents unread."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(root).select("path", "length", "modificationTime"))
    start = F.instr(F.col("path"), F.lit(root.rstrip("/") + "/"))
    inside = F.substring(F.col("path"), start + F.lit(len(root.rstrip("/")) + 1),
                         F.length("path"))
    return files.select(inside.alias("path"), "length",
                        F.col("modificationTime").alias("modified"))


def extension(path: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(path, r"[^/.]\.([^./]+)$", 1)), F.lit(""))


def known_media_types() -> dict[str, str]:
    """Python's own table of media types by extension, without what the machine adds."""
    return {e.lstrip("."): t for e, t in mimetypes.MimeTypes(filenames=()).types_map[True].items()}


def media_type(path: Column, types: dict[str, str] | None = None) -> Column:
    return F.coalesce(lookup(extension(path), types or known_media_types()),
                      F.lit(fv.DEFAULT_MEDIA_TYPE))


def safe_name(name: Column) -> Column:
    """Characters outside ``A-Za-z0-9._-`` become ``_``; the name ends in ``.pdf``."""
    plain = F.regexp_replace(strip(name), r"[^A-Za-z0-9._-]+", "_")
    named = F.when(plain == "", "order.pdf").otherwise(plain)
    return F.when(F.lower(named).endswith(".pdf"), named).otherwise(
        F.concat(named, F.lit(".pdf")))


def stored_path(name: Column, content_key: Column) -> Column:
    """Upload path; the prefix is a hash of the content key, so retries repeat it."""
    return F.concat(F.lit("orders/"), F.substring(F.sha2(content_key, 256), 1, 12),
                    F.lit("-"), safe_name(name))


def hash_suffix(path: Column, content_key: Column) -> Column:
    """Insert an eight-character hash before the extension."""
    mark = F.substring(F.sha2(content_key, 256), 1, 8)
    end = F.regexp_extract(path, r"(?<=[^/])(\.[^./]*)$", 1)
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(end))
    return F.concat(stem, F.lit("-"), mark, end)


def file_manifest(files: DataFrame, prefix: str = "", recursive: bool = True,
                  max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries below a prefix, and the files refused with a reason.

    Recursive listings hold files; others hold the immediate children, directories
    with a trailing ``/``. Both carry file counts and bytes; the refused files
    (bad path, no extension, over ``max_bytes`` if that is given) are left out of the entries.
    """
    below = "" if prefix in ("", "/") else prefix.rstrip("/") + "/"
    listed = files.where(F.col("path").startswith(below)) if below else files
    reason = (F.when(~F.col("path").rlike(fv.VALID_PATH), "invalid_path")
              .when(extension(F.col("path")).isNull(), "no_extension")
              .when(F.lit(max_bytes is not None) & (F.col("length") > (max_bytes or 0)), "too_large"))
    judged = listed.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull())
    rest = F.substring(F.col("path"), F.lit(len(below) + 1), F.length("path"))
    entry = F.col("path") if recursive else F.concat(
        F.lit(below), F.regexp_extract(rest, r"^[^/]+/?", 0))
    entries = good.groupBy(entry.alias("entry")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"))
    is_dir = F.col("entry").endswith("/")
    entries = entries.withColumn(
        "media_type", F.when(~is_dir, media_type(F.col("entry"))))
    return entries, judged.where(F.col("reason").isNotNull())


def directory_totals(files: DataFrame) -> DataFrame:
    """Files and bytes per directory, sub-directories not included."""
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    return files.groupBy(folder.alias("directory")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"))
