"""Listings from real folders.

The engine works on a listing DataFrame ``(folder_path, name, size,
mtime)``. ``listing_from_dir`` feeds one from a directory tree with the
``binaryFile`` source: only path, length and modification time are read
(the ``content`` column is pruned from the scan). Spark's file index skips
names starting with ``_`` or ``.`` and cannot show empty folders; pass a
listing table built by another tool when those matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import (DEFAULT_FILE_EXCLUSIONS, base_name, file_excluded,
                               folder_excluded, format_time, glob_match, join_path)


def listing_from_dir(spark: SparkSession, root: str, recursive: bool = False,
                     path_glob: str | None = None) -> DataFrame:
    """Files in the immediate sub-folders of ``root`` (every depth with
    ``recursive``)."""
    root = root.rstrip("/")
    reader = spark.read.format("binaryFile")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if recursive:
        df = reader.option("recursiveFileLookup", "true").load(root)
    else:
        df = reader.load(root + "/*/*")
    path = F.regexp_replace(F.col("path"), r"^file:(//)?", "")
    return df.select(
        F.regexp_replace(path, r"/[^/]*$", "").alias("folder_path"),
        base_name(path).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    )


def scan_files(listing: DataFrame, exclusions=DEFAULT_FILE_EXCLUSIONS) -> DataFrame:
    """Files kept after the name exclusions, with their full path."""
    return (listing.where(~file_excluded("name", exclusions))
            .withColumn("path", join_path("folder_path", "name")))


def scan_folders(listing: DataFrame, exclusions=()) -> DataFrame:
    """Distinct folders not excluded by exact folder name."""
    f = listing.select("folder_path").distinct().withColumn("folder_name", base_name("folder_path"))
    return f.where(~folder_excluded("folder_name", exclusions))


def scan_times(listing: DataFrame, exclusions=DEFAULT_FILE_EXCLUSIONS) -> DataFrame:
    """Files kept after the name exclusions, and their folders (``name`` null), each
    with its time to the second as text: a folder's is that of its latest file."""
    seen = listing.where(~file_excluded("name", exclusions))
    files = seen.select("folder_path", "name", "size", format_time("created_time").alias("created_time"))
    folders = listing.groupBy("folder_path").agg(F.max("created_time").alias("t")).select(
        "folder_path", F.lit(None).cast("string").alias("name"), F.lit(0).cast("bigint").alias("size"), format_time("t").alias("created_time"))
    return files.unionByName(folders)


def glob_search(listing: DataFrame, pattern: str) -> DataFrame:
    """Files whose name matches a shell glob (``*``, ``?``, ``[...]``)."""
    return (listing.where(glob_match("name", pattern))
            .select("folder_path", "name", join_path("folder_path", "name").alias("path")))


def folders_with_file(folders: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    """``has_file`` per folder: does exactly this file name exist there."""
    present = listing.where(F.col("name") == F.lit(name)).select("folder_path").distinct()
    return (folders.select("folder_path")
            .join(present.withColumn("has_file", F.lit(True)), "folder_path", "left")
            .select("folder_path", F.coalesce("has_file", F.lit(False)).alias("has_file")))


def listed_names(lists: DataFrame, names: str = "names") -> DataFrame:
    """Names given as ordered lists per folder -> (folder_path, ord, name);
    ``ord`` (0-based list position) is the listing order for grouping."""
    return lists.select("folder_path", F.posexplode(names).alias("ord", "name"))
