"""Snapshot writes as set-based rewrites.

Plain parquet has no UPDATE / MERGE, so every change produces the next
version of a table: unchanged rows pass through, updates are a join,
deletes an anti-join, inserts a union. Ids are surrogates: existing rows
keep theirs, new rows get ``max(id) + 1 + rank`` in key order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .indexing import ranged_index
from .stats import folder_stats

FOLDER_COLUMNS = ["id", "path", "total_size", "file_count"]
FILE_COLUMNS = ["id", "folder_id", "folder_path", "name", "size"]
KNOWN_CHANGES = ("added", "modified", "removed")
# kept in the snapshot when the listing has them; a modified file keeps its
# created_time and takes the new mtime
OPTIONAL_FILE_COLUMNS = ("created_time", "mtime")
OPTIONAL_FOLDER_COLUMNS = ("created_time",)


def _max_id(df: DataFrame) -> int:
    """Largest id in use (one scalar aggregate)."""
    v = df.agg(F.max("id")).first()[0]
    return int(v or 0)


def with_new_ids(df: DataFrame, order_by: list[str], start: int) -> DataFrame:
    """``id`` = start + rank in ``order_by`` order, numbered without a
    single-task window."""
    return ranged_index(df, [], order_by, out="id", base=start)


def initial_snapshot(listing: DataFrame, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """First load: folders (id by path order) with totals, and files (id by
    (folder path, name) order) pointing at their folder. ``paths``
    (folder_path): all folders, with or without files."""
    stats = folder_stats(listing, paths)
    folders = with_new_ids(stats, ["folder_path"], 1).select(
        "id", F.col("folder_path").alias("path"), "total_size", "file_count",
        *[c for c in OPTIONAL_FOLDER_COLUMNS if c in stats.columns])
    folders = materialize(folders, "folders")  # of a known size, so the files are joined where they are
    extra = [c for c in OPTIONAL_FILE_COLUMNS if c in listing.columns]
    files = listing.select("folder_path", "name", "size", *extra).join(
        folders.select(F.col("id").alias("folder_id"), F.col("path").alias("folder_path")),
        "folder_path")
    # folder ids follow the paths, and are cheaper to compare
    files = with_new_ids(files, ["folder_id", "name"], 1).select(*FILE_COLUMNS, *extra)
    return folders, files


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old`` are appended; rows with a
    key already present are ignored (``ON CONFLICT DO NOTHING``)."""
    fresh = new.join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def apply_folder_diffs(folders: DataFrame, diffs: DataFrame, max_id: int | None = None) -> DataFrame:
    """Changed folders take their live totals; new folders (folder_id 0)
    are inserted with fresh ids above ``max_id`` (default: that of ``folders``)."""
    upd = diffs.where(F.col("folder_id") != 0).select(
        F.col("folder_id").alias("id"), F.col("disk_total_size").alias("_ts"),
        F.col("disk_file_count").alias("_fc"))
    extra = [c for c in OPTIONAL_FOLDER_COLUMNS if c in folders.columns]
    kept = (folders.join(upd, "id", "left")
            .select("id", "path", F.coalesce("_ts", "total_size").alias("total_size"),
                    F.coalesce("_fc", "file_count").alias("file_count"), *extra))
    new = diffs.where(F.col("folder_id") == 0).select(
        F.col("path"), F.col("disk_total_size").alias("total_size"),
        F.col("disk_file_count").alias("file_count"),
        *[F.col(c) if c in diffs.columns else F.lit(None).cast(folders.schema[c].dataType).alias(c) for c in extra])
    new = new.join(folders.select("path"), "path", "left_anti")
    new = with_new_ids(new, ["path"], (_max_id(folders) if max_id is None else max_id) + 1).select(*FOLDER_COLUMNS, *extra)
    return kept.select(*FOLDER_COLUMNS, *extra).unionByName(new)


def apply_file_changes(files: DataFrame, changes: DataFrame, folders: DataFrame, max_id: int | None = None) -> DataFrame:
    """removed -> deleted, modified -> size replaced, added -> inserted with
    its folder's id (looked up by path in the already-updated ``folders``)
    and a fresh id above ``max_id`` (default: that of ``files``). Any other change
    type fails the job."""
    checked = changes.withColumn(
        "change_type",
        F.when(F.col("change_type").isin(*KNOWN_CHANGES), F.col("change_type"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown change type: "),
                                          F.coalesce(F.col("change_type"), F.lit("null"))))))
    # optional columns (mtime) travel along when both the snapshot and the
    # changes carry them
    extra = [c for c in OPTIONAL_FILE_COLUMNS if c in files.columns and f"disk_{c}" in changes.columns]
    cols = FILE_COLUMNS + [c for c in OPTIONAL_FILE_COLUMNS if c in files.columns]
    touch = checked.where(F.col("change_type") != "added").select(
        "folder_path", "name", "change_type", F.col("disk_size").alias("_new_size"),
        *[F.col(f"disk_{c}").alias(f"_new_{c}") for c in extra])
    kept = (files.join(touch, ["folder_path", "name"], "left")
            .where(F.col("change_type").isNull() | (F.col("change_type") != "removed")))
    for c, new in [("size", "_new_size")] + [(c, f"_new_{c}") for c in extra if c != "created_time"]:
        kept = kept.withColumn(c, F.when(F.col("change_type") == "modified", F.col(new)).otherwise(F.col(c)))
    kept = kept.select(*cols)
    added = checked.where(F.col("change_type") == "added").select(
        "folder_path", "name", F.col("disk_size").alias("size"),
        *[F.col(f"disk_{c}").alias(c) for c in extra])
    for c in cols:
        if c not in added.columns and c not in ("id", "folder_id"):
            added = added.withColumn(c, F.lit(None).cast(files.schema[c].dataType))
    added = added.join(files.select("folder_path", "name"), ["folder_path", "name"], "left_anti")
    added = added.join(folders.select(F.col("id").alias("folder_id"), F.col("path").alias("folder_path")),
                       "folder_path", "left")
    added = with_new_ids(added, ["folder_path", "name"], (_max_id(files) if max_id is None else max_id) + 1).select(*cols)
    return kept.unionByName(added)


def lookup_folder_ids(changes: DataFrame, folders: DataFrame) -> DataFrame:
    """Attach the folder id to each change by path. ``reject`` names the reason
    where there is none."""
    f = folders.select(F.col("path").alias("folder_path"), F.col("id").alias("folder_id"))
    return changes.drop("folder_id").join(f, "folder_path", "left").withColumn(
        "reject", F.when(F.col("folder_id").isNull(), F.lit("no stored folder")))


def cascade_delete(files: DataFrame, kept_folders: DataFrame) -> DataFrame:
    """Files whose folder is still present (delete of a folder removes its
    files)."""
    return files.join(kept_folders.select(F.col("id").alias("folder_id")), "folder_id", "left_semi")


def drop_folders(folders: DataFrame, paths: DataFrame) -> DataFrame:
    return folders.join(paths.select(F.col("folder_path").alias("path")), "path", "left_anti")
