"""Compare a live listing with a stored snapshot.

* ``folder_diff``: live folder totals left-joined to stored folders; new
  folders (id 0) and folders whose totals changed.
* ``file_changes``: one full outer join on (folder_path, name) for *all*
  folders at once: added / modified / removed.

By default only folders that exist in the listing are compared, so stored
folders that vanished are neither reported nor deleted;
``detect_removed=True`` reports them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

FOLDER_DIFF_COLUMNS = ["folder_id", "path", "disk_total_size", "db_total_size",
                       "disk_file_count", "db_file_count", "vanished"]
FILE_CHANGE_COLUMNS = ["change_type", "file_id", "folder_id", "folder_path", "name",
                       "disk_size", "db_size"]


def folder_diff(disk_stats: DataFrame, db_folders: DataFrame,
                detect_removed: bool = False) -> DataFrame:
    """``disk_stats``: (folder_path, total_size, file_count);
    ``db_folders``: (id, path, total_size, file_count). ``vanished``: the
    folder is stored but not on disk (only with ``detect_removed``)."""
    db = db_folders.select(F.col("id").alias("db_id"), F.col("path").alias("folder_path"),
                           F.col("total_size").alias("db_total_size"),
                           F.col("file_count").alias("db_file_count"))
    times = ["created_time"] if "created_time" in disk_stats.columns else []
    disk = disk_stats.select("folder_path", F.col("total_size").alias("disk_total_size"),
                             F.col("file_count").alias("disk_file_count"), *times)
    how = "full_outer" if detect_removed else "left"
    j = disk.join(db, "folder_path", how)
    changed = (F.col("db_id").isNull() | F.col("disk_total_size").isNull()
               | ~F.col("disk_total_size").eqNullSafe(F.col("db_total_size"))
               | ~F.col("disk_file_count").eqNullSafe(F.col("db_file_count")))
    return j.where(changed).select(
        F.coalesce("db_id", F.lit(0)).cast("bigint").alias("folder_id"),
        F.col("folder_path").alias("path"),
        F.coalesce("disk_total_size", F.lit(0)).cast("bigint").alias("disk_total_size"),
        F.coalesce("db_total_size", F.lit(0)).cast("bigint").alias("db_total_size"),
        F.coalesce("disk_file_count", F.lit(0)).cast("bigint").alias("disk_file_count"),
        F.coalesce("db_file_count", F.lit(0)).cast("bigint").alias("db_file_count"),
        F.col("disk_total_size").isNull().alias("vanished"), *times,
    )


def _paired(disk: DataFrame, db_files: DataFrame, compare: tuple[str, ...]) -> DataFrame:
    """Files on disk and stored files, full outer by (folder_path, name), with
    ``change_type`` (null: the same on both sides)."""
    carried = _carried(disk, db_files, compare)
    d = disk.select("folder_path", "name", F.lit(True).alias("_on_disk"),
                    *[F.col(c).alias(f"disk_{c}") for c in carried])
    s = db_files.select("folder_path", "name", F.col("id").alias("_file_id"),
                        F.col("folder_id").alias("_folder_id"), F.lit(True).alias("_in_db"),
                        *[F.col(c).alias(f"db_{c}") for c in carried])
    j = d.join(s, ["folder_path", "name"], "full_outer")
    differs = None
    for c in compare:
        cond = ~F.col(f"disk_{c}").eqNullSafe(F.col(f"db_{c}"))
        differs = cond if differs is None else (differs | cond)
    return j.withColumn("change_type", F.when(F.col("_in_db").isNull(), F.lit("added"))
                        .when(F.col("_on_disk").isNull(), F.lit("removed"))
                        .when(differs, F.lit("modified")))


def _carried(disk: DataFrame, db_files: DataFrame, compare: tuple[str, ...]) -> list[str]:
    carried = ["size"] + [c for c in compare if c != "size"]
    return carried + [c for c in ("created_time",) if c in disk.columns and c in db_files.columns and c not in carried]


def _changes(paired: DataFrame, carried: list[str]) -> DataFrame:
    extra = [c for c in carried if c != "size"]
    return paired.where(F.col("change_type").isNotNull()).select(
        "change_type",
        F.coalesce("_file_id", F.lit(0)).cast("bigint").alias("file_id"),
        F.coalesce("_folder_id", F.lit(0)).cast("bigint").alias("folder_id"),
        "folder_path", "name",
        F.coalesce("disk_size", F.lit(0)).cast("bigint").alias("disk_size"),
        F.coalesce("db_size", F.lit(0)).cast("bigint").alias("db_size"),
        *[F.col(f"disk_{c}") for c in extra], *[F.col(f"db_{c}") for c in extra],
    )


def file_changes(disk: DataFrame, db_files: DataFrame, detect_removed: bool = False,
                 compare: tuple[str, ...] = ("size",), live: DataFrame | None = None) -> DataFrame:
    """``disk``: (folder_path, name, size[, mtime]);
    ``db_files``: (id, folder_id, folder_path, name, size[, mtime]).

    ``live``: (folder_path) the folders that exist, with or without files
    (default: those of ``disk``). A file is modified when any ``compare`` column differs (size only by
    default: same-size edits are not seen)."""
    if not detect_removed:
        live = disk if live is None else live
        db_files = db_files.join(live.select("folder_path").distinct(), "folder_path", "left_semi")
    return _changes(_paired(disk, db_files, compare), _carried(disk, db_files, compare))


def diff_digest(disk: DataFrame, db_files: DataFrame, compare: tuple[str, ...] = ("size",)) -> DataFrame:
    """A row for each changed file, and one for all unchanged files of a folder, with
    the files on disk and their size that each stands for: all that both diffs need,
    from one scan of either side. Unchanged files are combined before the shuffle, so
    it is as large as the changes and the folders."""
    carried = _carried(disk, db_files, compare)
    changed = F.col("change_type").isNotNull()
    paired = _paired(disk, db_files, compare)
    return paired.groupBy("folder_path", F.when(changed, F.col("name")).alias("name"), "change_type").agg(
        F.sum("disk_size").cast("bigint").alias("total_size"), F.count("_on_disk").alias("file_count"),
        F.max("_file_id").alias("_file_id"), F.max("_folder_id").alias("_folder_id"),
        *[F.max(f"{side}_{c}").alias(f"{side}_{c}") for c in carried for side in ("disk", "db")],
        *[F.min(f"disk_{c}").alias(c) for c in carried if c == "created_time"])


def diff_pass(disk: DataFrame, db_folders: DataFrame, db_files: DataFrame, folders: DataFrame | None = None,
              detect_removed: bool = False, compare: tuple[str, ...] = ("size",)) -> DataFrame:
    """``folder_diff`` and ``file_changes`` of one listing as one frame, told apart
    by ``kind`` (folder, file): see ``of_kind``. Both come from the written
    ``diff_digest``, so the listing is scanned once.

    ``folders`` (folder_path[, created_time]): folders that exist, with or without
    files; folders of the listing always do."""
    carried = _carried(disk, db_files, compare)
    digest = materialize(diff_digest(disk, db_files, compare), "diff-digest")
    times = ["created_time"] if "created_time" in carried else []
    totals = digest.groupBy("folder_path").agg(
        F.coalesce(F.sum("total_size"), F.lit(0)).cast("bigint").alias("total_size"), F.sum("file_count").alias("file_count"),
        *[F.min(c).alias(c) for c in times]).where("file_count > 0")
    if folders is not None:
        own = [F.col("created_time").alias("_own")] if times and "created_time" in folders.columns else []
        totals = folders.select("folder_path", *own).join(totals, "folder_path", "full_outer").select(
            "folder_path", F.coalesce("total_size", F.lit(0)).alias("total_size"), F.coalesce("file_count", F.lit(0)).alias("file_count"),
            *[F.coalesce(*(["_own"] if own else []), c).alias(c) for c in times])
    changes = _changes(digest, carried)
    if not detect_removed:
        changes = changes.join(totals.select("folder_path"), "folder_path", "left_semi")
    fdiff = folder_diff(totals, db_folders, detect_removed)
    return (fdiff.withColumn("kind", F.lit("folder"))
            .unionByName(changes.withColumn("kind", F.lit("file")), allowMissingColumns=True))


def of_kind(diff: DataFrame, kind: str) -> DataFrame:
    """The ``folder`` or ``file`` rows of a ``diff_pass``, with their columns."""
    times = ["created_time"] if "created_time" in diff.columns else []
    if kind == "folder":
        return diff.where("kind = 'folder'").select(*FOLDER_DIFF_COLUMNS, *times)
    extra = [c for c in diff.columns if c.startswith(("disk_", "db_")) and c not in FILE_CHANGE_COLUMNS + FOLDER_DIFF_COLUMNS]
    return diff.where("kind = 'file'").select(*FILE_CHANGE_COLUMNS, *extra)


def change_summary(folder_diffs: DataFrame, changes: DataFrame) -> DataFrame:
    """Counts per kind: folder_new, folder_changed, folder_removed, added,
    modified, removed (kinds with no rows are reported with 0)."""
    f = folder_diffs.select(F.when(F.col("folder_id") == 0, "folder_new")
                            .when(F.col("vanished"), "folder_removed")
                            .otherwise("folder_changed").alias("kind"))
    c = changes.select(F.col("change_type").alias("kind"))
    counts = f.unionByName(c).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = folder_diffs.sparkSession.createDataFrame(
        [(k,) for k in ("folder_new", "folder_changed", "folder_removed", "added", "modified", "removed")], "kind string")
    return (kinds.join(counts, "kind", "left")
            .select("kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))
