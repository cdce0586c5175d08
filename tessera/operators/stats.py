"""Folder statistics: live totals from a listing, refresh of stored totals
from the stored files, and drift between the two.

All are single ``groupBy`` aggregates (map-side partial sums, so a folder
holding a third of the files costs one partial row per map task)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folder_stats(listing: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(folder_path, total_size, file_count). With ``folders`` (a frame with
    ``folder_path``), folders without files report 0 / 0. A listing with
    ``created_time`` adds the folder's: that of ``folders`` if it has one, else
    its earliest file's."""
    times = [F.min("created_time").alias("created_time")] if "created_time" in listing.columns else []
    stats = (listing.groupBy("folder_path")
             .agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_size"),
                  F.count(F.lit(1)).alias("file_count"), *times))
    if folders is None:
        return stats
    own = [F.col("created_time").alias("_own")] if times and "created_time" in folders.columns else []
    if times:
        times = [F.coalesce(*(["_own"] if own else []), "created_time").alias("created_time")]
    return (folders.select("folder_path", *own).join(stats, "folder_path", "left")
            .select("folder_path",
                    F.coalesce("total_size", F.lit(0)).cast("bigint").alias("total_size"),
                    F.coalesce("file_count", F.lit(0)).cast("bigint").alias("file_count"), *times))


def _file_totals(files: DataFrame) -> DataFrame:
    return (files.groupBy("folder_id")
            .agg(F.sum("size").cast("bigint").alias("current_size"),
                 F.count(F.lit(1)).alias("current_count")))


def stats_refresh(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Stored folders with totals recomputed from their stored files
    (null-safe: a folder without files gets 0 / 0). One aggregate and one
    join instead of two correlated subqueries per folder."""
    t = _file_totals(files)
    j = folders.join(t, folders["id"] == t["folder_id"], "left")
    times = [c for c in ("created_time",) if c in folders.columns]
    return j.select("id", "path",
                    F.coalesce("current_size", F.lit(0)).cast("bigint").alias("total_size"),
                    F.coalesce("current_count", F.lit(0)).cast("bigint").alias("file_count"), *times)


def totals_by_changes(folders: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, total_size, file_count) kept by adding the signed deltas of a change
    set to the stored totals: the work follows the changes, not the files. New
    folders start from zero; equals a full refresh after the changes are applied."""
    sign = F.when(F.col("change_type") == "added", 1).when(F.col("change_type") == "removed", -1).otherwise(0)
    delta = changes.groupBy(F.col("folder_path").alias("path")).agg(
        F.sum(F.col("disk_size") - F.col("db_size")).cast("bigint").alias("_size"), F.sum(sign).cast("bigint").alias("_count"))

    def plus(a, b):
        return (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("bigint").alias(a)

    return folders.select("path", "total_size", "file_count").join(delta, "path", "full_outer").select(
        "path", plus("total_size", "_size"), plus("file_count", "_count"))


def stat_drift(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders whose stored totals differ from the totals of their files."""
    t = _file_totals(files)
    j = folders.join(t, folders["id"] == t["folder_id"], "left")
    cur_size = F.coalesce("current_size", F.lit(0)).cast("bigint")
    cur_count = F.coalesce("current_count", F.lit(0)).cast("bigint")
    return (j.select("path", "total_size", "file_count",
                     cur_size.alias("current_size"), cur_count.alias("current_count"))
            .where((F.col("total_size") != F.col("current_size"))
                   | (F.col("file_count") != F.col("current_count"))))
