"""Snapshot load, sync and the version gate, as driver functions that chain
Spark jobs. Each step is a set-based DataFrame job; the driver only sees
counts, the version pointer and the final status."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.apply import (apply_file_changes, apply_folder_diffs, cascade_delete,
                               drop_folders, initial_snapshot)
from ..operators.diff import diff_pass, of_kind
from ..functions.names import DEFAULT_FILE_EXCLUSIONS, base_name, file_excluded, folder_excluded
from ..session import materialize, scratch_job
from ..sources.rules import RulePlan, folder_rules, plan_rules
from ..sources.store import TABLES, ConcurrentCommit, VersionedStore
from .build import build_blocks, incremental_blocks

#: Rows from which a table that is in order of its folders is written as it stands,
#: without a shuffle by bucket, which only gathers a small table's rows in few files.
ORDERED = 1_000_000
STATUS_SCHEMA = ("updated boolean, version long, folder_diffs long, file_changes long, "
                 "blocks long, updated_at timestamp_ntz")


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)


def _status(spark, updated, version, n_fd, n_ch, n_blocks, stamp) -> DataFrame:
    return spark.createDataFrame([(updated, version, n_fd, n_ch, n_blocks, stamp)], STATUS_SCHEMA)


def _scanned(listing: DataFrame, folders: DataFrame | None, file_exclusions, folder_exclusions):
    """(listing, folders) that a scan sees: files and folders that aren't
    excluded by name, and all folders, with or without files."""
    paths = listing.select("folder_path")
    paths = (paths if folders is None else paths.union(folders.select("folder_path"))).distinct()
    paths = paths.where(~folder_excluded(base_name("folder_path"), folder_exclusions))
    seen = listing.where(~folder_excluded(base_name("folder_path"), folder_exclusions) & ~file_excluded("name", file_exclusions))
    return seen, paths


def initial_load(store: VersionedStore, listing: DataFrame, rules: DataFrame,
                 updated_at: dt.datetime | None = None, *, folders: DataFrame | None = None,
                 file_exclusions=DEFAULT_FILE_EXCLUSIONS, folder_exclusions=()) -> DataFrame:
    """Version 0: snapshot of the listing plus all its blocks. Raises if the
    store has a committed version. ``folders`` and exclusions: see sync()."""
    if store.current() is not None:
        raise FileExistsError(f"{store.root} has a committed version")
    stamp = updated_at or _now()
    with scratch_job(store.spark):
        # read for the paths, totals, files, folder rules and cells: derived once
        listing, paths = _scanned(materialize(listing, "listing"), folders, file_exclusions, folder_exclusions)
        new_folders, files = initial_snapshot(listing, paths)
        b = build_blocks(listing, rules, folders=new_folders.select(F.col("path").alias("folder_path")), valid_only=True)
        rows = b.block_rows  # numbered once, for the heads too
        heads = materialize(b.block_heads, "heads")
        # both tables come numbered in order of their folders
        sizes = {"files": new_folders.agg(F.sum("file_count")).first()[0], "block_rows": heads.agg(F.sum("n_rows")).first()[0]}
        version = store.commit({"folders": new_folders, "files": files, "block_heads": heads, "block_rows": rows}, stamp, version=0,
                               ordered={table for table, n in sizes.items() if (n or 0) >= ORDERED})
        return _status(store.spark, True, version, 0, 0, heads.count(), stamp)


def sync(store: VersionedStore, listing: DataFrame, rules: DataFrame, *, force: bool = False,
         updated_at: dt.datetime | None = None, detect_removed: bool = False,
         compare: tuple[str, ...] = ("size",), folders: DataFrame | None = None,
         file_exclusions=DEFAULT_FILE_EXCLUSIONS, folder_exclusions=()) -> DataFrame:
    """Compare the listing with the current version; when anything changed
    (or on the first run, or with ``force``) write the next version: only the
    buckets of folders that changed are read, changed and written, blocks of
    changed folders are rebuilt, and one publish stamp holds for the whole version.

    ``folders`` (folder_path): the folders that exist; those without files are
    stored with totals 0, and files of a folder that was emptied are removed.
    Folders of the listing are always among them. Excluded folders count as
    not there; excluded files are not seen. A folder that is not there any more keeps
    its files and its block, unreported, unless ``detect_removed``. An edited rule is
    a change: its folders' blocks are rebuilt. ``compare=("size", "mtime")`` also sees
    same-size edits when the listing carries ``mtime``. Returns a one-row
    status frame.

    Another writer that commits meanwhile: if it changed none of the buckets
    that this sync touches, the sync starts again from its version; else
    ConcurrentCommit is raised and nothing is written."""
    while True:
        cur = store.current()
        if cur is None:
            return initial_load(store, listing, rules, updated_at, folders=folders,
                                file_exclusions=file_exclusions, folder_exclusions=folder_exclusions)
        touched: list[int] = []
        try:
            return _sync_from(store, cur, listing, rules, touched, force, updated_at, detect_removed, compare, folders,
                              file_exclusions, folder_exclusions)
        except ConcurrentCommit as e:
            if e.buckets & set(touched):
                raise


def _sync_from(store, cur, listing, rules, touched, force, updated_at, detect_removed, compare, folders, file_exclusions, folder_exclusions):
    spark, (version, published) = store.spark, cur
    given = folders
    listing, paths = _scanned(listing, folders, file_exclusions, folder_exclusions)
    if given is not None:
        given = given.select("folder_path").distinct().where(~folder_excluded(base_name("folder_path"), folder_exclusions))
    plan = plan_rules(rules)
    with scratch_job(spark):
        diff, seen = materialize(
            diff_pass(listing, store.read("folders", version), store.read("files", version), given, detect_removed, compare), "diff",
            n_fd=F.count_if(F.col("kind") == "folder"), n_ch=F.count_if(F.col("kind") == "file"))
        fdiff, changes = of_kind(diff, "folder"), of_kind(diff, "file")
        edited = materialize(_edited_rules(store.read("block_heads", version), listing, plan), "edited-rules")
        changed = (changes.select("folder_path").union(fdiff.select("path"))).distinct()
        touched += store.buckets_of(changed.union(edited))
        if not force and not touched:
            return _status(spark, False, version, 0, 0, 0, published)
        stamp = updated_at or _now()
        tables = {}
        if touched:
            stored = store.tables(version)
            old_folders, files, old_heads, old_rows = (store.read(t, version, touched) for t in TABLES)
            new_folders = apply_folder_diffs(old_folders, fdiff, stored["folders"].max_id)
            new_files = apply_file_changes(files, changes, new_folders, stored["files"].max_id)
            if detect_removed:
                new_folders = drop_folders(new_folders, fdiff.where("vanished").select(F.col("path").alias("folder_path")))
                new_files = cascade_delete(new_files, new_folders)
            heads, rows = incremental_blocks(old_heads, old_rows, listing.where(store.inside("folder_path", touched)), plan, changed,
                                             existing=None if detect_removed else paths)
            tables = {"folders": new_folders, "files": new_files, "block_heads": heads, "block_rows": rows}
        new_version = store.commit(tables, stamp, base=version, touched=touched)
        # parquet footers give the number of blocks
        return _status(spark, True, new_version, seen["n_fd"], seen["n_ch"], store.read("block_heads", new_version).count(), stamp)


def _edited_rules(heads: DataFrame, listing: DataFrame, plan: RulePlan) -> DataFrame:
    """(folder_path) of the listing's folders with a valid rule that their block
    wasn't built with, or a block but no valid rule any more."""
    live = listing.select("folder_path").distinct()
    now = folder_rules(live, plan).where("rule_ok").select("folder_path", F.col("rule_hash").alias("_now"))
    before = heads.select(F.col("block_id").alias("folder_path"), "rule_hash").join(live, "folder_path", "left_semi")
    return (now.join(before, "folder_path", "full_outer")
            .where(~F.col("_now").eqNullSafe(F.col("rule_hash"))).select("folder_path"))


def gate_status(client_updated_at: Column, server_updated_at) -> Column:
    """'send' when the client has nothing or an older stamp, 'no_update'
    when equal, 'error' when the client claims a newer stamp."""
    server = F.lit(str(server_updated_at)).cast("timestamp_ntz")
    return (F.when(client_updated_at.isNull() | (client_updated_at < server), F.lit("send"))
            .when(client_updated_at == server, F.lit("no_update"))
            .otherwise(F.lit("error")))


def get_datablock(store: VersionedStore, client_updated_at: dt.datetime | None = None):
    """(block_heads, block_rows, no_update) for one client: everything when
    its stamp is missing or older, nothing when equal; newer is an error."""
    cur = store.current()
    if cur is None:
        raise FileNotFoundError("no published block set")
    version, server = cur
    if server is None:
        raise ValueError("server block set has no updated_at")
    if client_updated_at is None or client_updated_at < server:
        return (store.read("block_heads", version)
                .withColumn("updated_at", F.lit(str(server)).cast("timestamp_ntz")),
                store.read("block_rows", version), False)
    if client_updated_at == server:
        return None, None, True
    raise ValueError("the client's block set is newer than the published one")
