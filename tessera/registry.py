"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Inputs are listings derived from the given tables (``sources.derived``)
and the fixture rules (``sources.rules``); ``oracle_sql.ORACLE`` holds the
DuckDB SQL that recomputes each one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.names import (BLOCK_DIR_EXCLUSIONS, DEFAULT_FILE_EXCLUSIONS, base_name,
                              file_excluded, folder_excluded)
from .operators import apply as dml
from .operators.blocks import datablock as stamp_blocks
from .operators.blocks import generate_rows as rows_from_cells
from .operators.blocks import long_cells, merge_blocks, override_headers
from .operators.diff import change_summary as summarize_changes
from .operators.diff import diff_pass
from .operators.diff import file_changes as diff_files
from .operators.diff import folder_diff as diff_folders
from .operators.grouping import NameGrouping, name_keys, name_parts
from .operators.indexing import ranged_index
from .operators.stats import folder_stats as stats_of
from .operators.stats import stat_drift as drift_of
from .operators.stats import stats_refresh, totals_by_changes
from .plans.build import build_blocks
from .plans.build import incremental_blocks as rebuild_changed
from .plans.sync import gate_status, initial_load
from .plans.sync import sync as run_sync
from .session import materialize, scratch_path
from .sinks.files import csv_lines, header_widths, json_dump, read_lines, write_csv, write_dump, write_invalid
from .sources import derived
from .sources.listing import folders_with_file, scan_files, scan_folders, scan_times
from .sources.listing import glob_search as search_glob
from .sources.listing import listed_names as explode_lists
from .sources.rules import FIXTURE_RULES, assign_rules, folder_rules, plan_rules, rules_frame
from .sources.rules import rule_conflicts as conflicts_of
from .sources.store import TABLES, VersionedStore
from .sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed parameters of the registered queries.
FOLDER_EXCLUSIONS = ("f3", "g7", "run_15")
GLOB_PATTERN = "*_R1_*.fastq.gz"
REQUIRED_NAME = "doc_10.txt"
READ_BLOCK = "/data/run_03"
OVERRIDE_HEADERS = ["left", "right"]
ROW_HEADERS = ["type", "user"]
PUBLISHED_AT = dt.datetime(2024, 1, 15, 12, 0, 0)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def kept(listing: DataFrame, exclusions=DEFAULT_FILE_EXCLUSIONS) -> DataFrame:
    return listing.where(~file_excluded("name", exclusions))


def catalog(t: Tables) -> DataFrame:
    """runs + messy (default exclusions) + events listings."""
    return (derived.runs_listing(t)
            .unionByName(kept(derived.messy_listing(t)))
            .unionByName(derived.events_listing(t)))


def all_listings(t: Tables) -> DataFrame:
    return catalog(t).unionByName(derived.docs_all(t).drop("created_time"))


def _t(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


def written(listing: DataFrame) -> DataFrame:
    """A derived listing as a table, as a crawler would leave it: the folder list and
    the names are read from it without deriving it again."""
    return materialize(listing, "listing")


def _grouping(spark, sf_dir, **options) -> NameGrouping:
    return NameGrouping(written(catalog(_t(spark, sf_dir))), rules_frame(spark), **options)


def _joined(arr, field: str | None = None, sep: str = ","):
    if field is not None:
        arr = F.transform(arr, lambda e: e[field])
    return F.array_join(arr, sep)


def _stored(listing: DataFrame):
    """A listing's snapshot: stored folders (ids by path; totals as stored,
    some stale) and stored files (ids by folder path, name)."""
    folders, files = (materialize(x) for x in dml.initial_snapshot(listing))
    stored = derived.stored_totals(listing).join(folders.select("id", "path", "created_time"), "path")
    return stored.select(*dml.FOLDER_COLUMNS, "created_time"), files


def _stored_old(t: Tables):
    return _stored(derived.docs_old(t))


def _stored_all(t: Tables):
    return _stored(derived.docs_all(t))


def _file_diff(new: DataFrame, files: DataFrame) -> DataFrame:
    return materialize(diff_files(new, files))


# ---------------------------------------------------------------- scans

@query
def folder_scan(spark, sf_dir):
    return scan_folders(all_listings(_t(spark, sf_dir)), FOLDER_EXCLUSIONS)


@query
def file_scan(spark, sf_dir):
    return scan_files(derived.messy_listing(_t(spark, sf_dir)))


@query
def scan_with_times(spark, sf_dir):
    return scan_times(derived.docs_all(_t(spark, sf_dir)), (REQUIRED_NAME, *DEFAULT_FILE_EXCLUSIONS))


@query
def name_scan(spark, sf_dir):
    return kept(derived.messy_listing(_t(spark, sf_dir)), BLOCK_DIR_EXCLUSIONS).select("folder_path", "name")


@query
def glob_search(spark, sf_dir):
    return search_glob(derived.messy_listing(_t(spark, sf_dir)), GLOB_PATTERN)


@query
def folders_missing_file(spark, sf_dir):
    listing = derived.docs_all(_t(spark, sf_dir))
    return folders_with_file(listing.select("folder_path").distinct(), listing, REQUIRED_NAME)


@query
def rules_by_folder(spark, sf_dir):
    folders = all_listings(_t(spark, sf_dir)).select("folder_path").distinct()
    fr = folder_rules(folders, rules_frame(spark))
    return folders.join(fr, "folder_path", "left").select(
        "folder_path", "folder_prefix", "version",
        F.size(F.coalesce("header", F.array().cast("array<string>"))).alias("n_header"))


@query
def snapshot_folders(spark, sf_dir):
    store = VersionedStore(spark, scratch_path(spark, "snapshot"))
    initial_load(store, derived.docs_all(_t(spark, sf_dir)), rules_frame(spark), PUBLISHED_AT)
    return store.read("folders")


@query
def snapshot_files(spark, sf_dir):
    store = VersionedStore(spark, scratch_path(spark, "snapshot"))
    initial_load(store, derived.docs_all(_t(spark, sf_dir)), rules_frame(spark), PUBLISHED_AT)
    return store.read("files")


@query
def runs_snapshot(spark, sf_dir):
    """Load test: the runs listing (every order line, both reads) as a
    stored snapshot, read back from the store."""
    store = VersionedStore(spark, scratch_path(spark, "runs-snapshot"))
    folders, files = dml.initial_snapshot(derived.runs_listing(_t(spark, sf_dir)))
    store.commit({"folders": folders, "files": files}, PUBLISHED_AT, version=0)
    return store.read("files")


@query
def files_for_folder(spark, sf_dir):
    """Files of the folder with the most files, looked up by its path."""
    folders, files = (materialize(x) for x in dml.initial_snapshot(derived.docs_all(_t(spark, sf_dir))))
    largest = folders.orderBy(F.col("file_count").desc(), "path").select("path").first()
    f = folders.where(F.col("path") == (largest[0] if largest else None)).select(F.col("id").alias("folder_id"))
    return files.join(f, "folder_id").select("id", "folder_id", "name", "size", "created_time")


@query
def folder_id_lookup(spark, sf_dir):
    t = _t(spark, sf_dir)
    folders, files = _stored_old(t)
    changes = _file_diff(derived.docs_new(t), files)
    return dml.lookup_folder_ids(changes, folders).select("change_type", "folder_path", "name", "folder_id", "reject")


@query
def datablock_read(spark, sf_dir):
    store = VersionedStore(spark, scratch_path(spark, "publish"))
    initial_load(store, catalog(_t(spark, sf_dir)), rules_frame(spark), PUBLISHED_AT)
    return long_cells(store.read("block_rows"))


@query
def fileblock_read(spark, sf_dir):
    store = VersionedStore(spark, scratch_path(spark, "publish"))
    initial_load(store, derived.runs_listing(_t(spark, sf_dir)), rules_frame(spark), PUBLISHED_AT)
    return long_cells(store.read_block(READ_BLOCK))


@query
def listed_names(spark, sf_dir):
    docs = _t(spark, sf_dir).documents.select("doc_id", "text")
    lists = docs.select(F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("folder_path"),
                        F.split("text", "\n").alias("names"))
    return explode_lists(lists)


# ---------------------------------------------------------- predicates

@query
def exclude_files(spark, sf_dir):
    m = derived.messy_listing(_t(spark, sf_dir))
    return m.select("folder_path", "name", file_excluded("name", DEFAULT_FILE_EXCLUSIONS).alias("excluded"))


@query
def exclude_folders(spark, sf_dir):
    f = all_listings(_t(spark, sf_dir)).select("folder_path").distinct()
    return f.select("folder_path", base_name("folder_path").alias("folder_name"),
                    folder_excluded(base_name("folder_path"), FOLDER_EXCLUSIONS).alias("excluded"))


@query
def size_rule_filter(spark, sf_dir):
    m = assign_rules(kept(derived.messy_listing(_t(spark, sf_dir))), rules_frame(spark))
    in_range = (F.col("size") >= F.col("min_size")) & ((F.col("max_size") <= 0) | (F.col("size") <= F.col("max_size")))
    return m.where(in_range).select("folder_path", "name", "size")


# ----------------------------------------------------- scalar functions

@query
def split_names(spark, sf_dir):
    plan = plan_rules(rules_frame(spark))
    p = name_parts(plan.attach(kept(derived.messy_listing(_t(spark, sf_dir)))), plan)
    return p.select("folder_path", "name", F.size("parts").alias("n_parts"),
                    F.array_join("parts", "|").alias("parts"))


@query
def row_col_keys(spark, sf_dir):
    plan = plan_rules(rules_frame(spark))
    keyed = name_keys(plan.attach(catalog(_t(spark, sf_dir))), plan)
    return keyed.select("folder_path", "name", "row_key", "col_key")


@query
def block_names(spark, sf_dir):
    f = all_listings(_t(spark, sf_dir)).select("folder_path").distinct()
    return f.select("folder_path", F.concat(base_name("folder_path"), F.lit("files.pb")).alias("block_file"))


@query
def generate_rows(spark, sf_dir):
    e = _t(spark, sf_dir).events.select(
        "event_id", F.array("event_type", F.col("user_id").cast("string"), "props").alias("cells"))
    rows = generate_rows_of(e)
    return rows.select("row_number", F.explode("cells").alias("header", "cell"))


def generate_rows_of(e: DataFrame) -> DataFrame:
    return rows_from_cells(e, "cells", ["event_id"], ROW_HEADERS)


# -------------------------------------------------------------- joins

@query
def folder_diff(spark, sf_dir):
    t = _t(spark, sf_dir)
    folders, _ = _stored_old(t)
    return diff_folders(stats_of(derived.docs_new(t)), folders).drop("vanished", "created_time")


@query
def file_changes(spark, sf_dir):
    t = _t(spark, sf_dir)
    _, files = _stored_old(t)
    return diff_files(derived.docs_new(t), files).drop("disk_created_time", "db_created_time")


@query
def cascade_delete(spark, sf_dir):
    t = _t(spark, sf_dir)
    folders, files = _stored_old(t)
    live = derived.docs_new(t).select("folder_path").distinct()
    kept_folders = folders.join(live.select(F.col("folder_path").alias("path")), "path", "left_semi")
    return dml.cascade_delete(files, kept_folders).select("id", "folder_id", "name", "size")


@query
def rule_join(spark, sf_dir):
    j = assign_rules(catalog(_t(spark, sf_dir)), rules_frame(spark))
    return j.select("folder_path", "name", "folder_prefix", "version", F.size("header").alias("n_header"))


# ------------------------------------------------------- aggregations

@query
def folder_stats(spark, sf_dir):
    return stats_of(all_listings(_t(spark, sf_dir)))


@query
def folder_stats_refresh(spark, sf_dir):
    folders, files = _stored_all(_t(spark, sf_dir))
    return stats_refresh(folders, files)


@query
def folder_totals_incremental(spark, sf_dir):
    """Totals of the old corpus's folders, carried to the new corpus by its changes."""
    t = _t(spark, sf_dir)
    folders, files = (materialize(x) for x in dml.initial_snapshot(derived.docs_old(t)))
    return totals_by_changes(folders, diff_files(derived.docs_new(t), files))


@query
def stat_drift(spark, sf_dir):
    folders, files = _stored_all(_t(spark, sf_dir))
    return drift_of(folders, files)


@query
def group_files_long(spark, sf_dir):
    return _grouping(spark, sf_dir).cells.select("folder_path", "row_key", "col_key", "name", "n_names")


@query
def group_files(spark, sf_dir):
    r = _grouping(spark, sf_dir).numbered_rows()
    return r.select("folder_path", "row_index", "row_key", "n_cols",
                    F.col("first_seen").alias("first_name"))


@query
def column_keys(spark, sf_dir):
    return _grouping(spark, sf_dir).column_keys()


@query
def rule_conflicts(spark, sf_dir):
    folders = all_listings(_t(spark, sf_dir)).select("folder_path").distinct()
    fr = conflicts_of(folder_rules(folders, rules_frame(spark)))
    return fr.select("folder_path", "folder_prefix", "valid", "conflict_parts")


@query
def change_summary(spark, sf_dir):
    t = _t(spark, sf_dir)
    folders, files = _stored_old(t)
    new = derived.docs_new(t)
    return summarize_changes(diff_folders(stats_of(new), folders), diff_files(new, files))


# ------------------------------------------------- window-shaped logic

@query
def valid_groups(spark, sf_dir):
    """Valid rows of every folder, numbered by first appearance."""
    v = _grouping(spark, sf_dir).valid_groups()
    return v.select("folder_path", "row_number", "row_key",
                    F.col("first_seen").alias("first_name"), "n_cols",
                    _joined("entries", "col_key").alias("col_keys"),
                    _joined("entries", "name").alias("names"))


@query
def cell_collisions(spark, sf_dir):
    return _grouping(spark, sf_dir, keep_keyed=True).collisions()


# ---------------------------------------------------------- set ops

@query
def invalid_files(spark, sf_dir):
    return _grouping(spark, sf_dir).invalid_files().select("folder_path", "name")


@query
def insert_if_absent(spark, sf_dir):
    t = _t(spark, sf_dir)
    return dml.insert_if_absent(derived.docs_old(t), derived.docs_new(t), ["folder_path", "name"]).drop("created_time")


# ------------------------------------------------------------ blocks

def _blocks(spark, sf_dir):
    t = _t(spark, sf_dir)
    return build_blocks(written(all_listings(t)), rules_frame(spark), valid_only=True)


@query
def fileblock_rows(spark, sf_dir):
    return long_cells(_blocks(spark, sf_dir).block_rows)


@query
def fileblock(spark, sf_dir):
    h = _blocks(spark, sf_dir).block_heads
    return h.select("block_id", _joined("column_headers").alias("column_headers"), "n_rows",
                    "rule_version", "block_file")


@query
def block_rejects(spark, sf_dir):
    return _blocks(spark, sf_dir).rejects


@query
def block_header_override(spark, sf_dir):
    h = override_headers(_blocks(spark, sf_dir).block_heads, OVERRIDE_HEADERS)
    return h.select("block_id", _joined("column_headers").alias("column_headers"), "n_rows")


@query
def datablock(spark, sf_dir):
    d = stamp_blocks(_blocks(spark, sf_dir).block_heads, PUBLISHED_AT)
    return d.select("block_id", "n_rows", "rule_version", "updated_at")


@query
def incremental_blocks(spark, sf_dir):
    t = _t(spark, sf_dir)
    rules = rules_frame(spark)
    old, new = derived.docs_old(t), derived.docs_new(t)
    before = build_blocks(old, rules, valid_only=True)
    old_rows = before.block_rows  # numbered once, for the heads too
    folders, files = _stored_old(t)
    changed = (diff_files(new, files).select("folder_path")
               .unionByName(diff_folders(stats_of(new), folders).select(F.col("path").alias("folder_path")))
               .distinct())
    _, rows = rebuild_changed(before.block_heads, old_rows, new, before.plan, changed)
    return long_cells(rows)


@query
def datablock_dump(spark, sf_dir):
    b = build_blocks(written(derived.runs_listing(_t(spark, sf_dir))), rules_frame(spark), valid_only=True)
    return json_dump(b.block_rows, b.block_heads)


@query
def fileblock_dump(spark, sf_dir):
    """Text dump of one published block."""
    store = VersionedStore(spark, scratch_path(spark, "publish"))
    initial_load(store, derived.runs_listing(_t(spark, sf_dir)), rules_frame(spark), PUBLISHED_AT)
    return json_dump(store.read_block(READ_BLOCK), store.read("block_heads"), READ_BLOCK)


@query
def merged_blocks(spark, sf_dir):
    """One set from three published ones: the old corpus, the catalog, and the
    new corpus, whose blocks replace the old corpus's."""
    t = _t(spark, sf_dir)
    sets = []
    for listing in (derived.docs_old(t), catalog(t), derived.docs_new(t)):
        store = VersionedStore(spark, scratch_path(spark, "publish"))
        initial_load(store, listing, rules_frame(spark), PUBLISHED_AT)
        sets.append((store.read("block_heads"), store.read("block_rows")))
    heads, rows = merge_blocks(sets)
    stamped = stamp_blocks(heads, PUBLISHED_AT).select("block_id", "updated_at")
    return long_cells(rows).join(stamped, "block_id")


# -------------------------------------------------------- snapshot DML

@query
def initial_snapshot(spark, sf_dir):
    _, files = dml.initial_snapshot(derived.docs_all(_t(spark, sf_dir)))
    return files


@query
def apply_folder_diffs(spark, sf_dir):
    t = _t(spark, sf_dir)
    folders, _ = _stored_old(t)
    return dml.apply_folder_diffs(folders, diff_folders(stats_of(derived.docs_new(t)), folders))


@query
def apply_file_changes(spark, sf_dir):
    t = _t(spark, sf_dir)
    folders, files = _stored_old(t)
    new = derived.docs_new(t)
    upserted = dml.apply_folder_diffs(folders, diff_folders(stats_of(new), folders))
    return dml.apply_file_changes(files, diff_files(new, files), upserted)


@query
def snapshot_apply(spark, sf_dir):
    t = _t(spark, sf_dir)
    rules = rules_frame(spark)
    store = VersionedStore(spark, scratch_path(spark, "apply"))
    initial_load(store, derived.docs_old(t), rules, PUBLISHED_AT)
    run_sync(store, derived.docs_new(t), rules, updated_at=PUBLISHED_AT + dt.timedelta(days=1))
    return store.read("files")


@query
def clear_snapshot(spark, sf_dir):
    """Rows of each stored table before and after a clear, read back by version."""
    store = VersionedStore(spark, scratch_path(spark, "clear"))
    initial_load(store, derived.docs_all(_t(spark, sf_dir)), rules_frame(spark), PUBLISHED_AT)
    cleared = store.clear(PUBLISHED_AT + dt.timedelta(days=1))

    def counted(version, name):
        tables = [store.read(table, version).agg(F.lit(table).alias("table_name"), F.count(F.lit(1)).alias(name)) for table in TABLES]
        return reduce(DataFrame.unionByName, tables)

    return counted(cleared - 1, "rows_before").join(counted(cleared, "rows_after"), "table_name")


# ------------------------------------------------------------- sinks

@query
def csv_layout(spark, sf_dir):
    b = build_blocks(written(catalog(_t(spark, sf_dir))), rules_frame(spark))
    keys = b.grouping.valid_cells.select("folder_path", "col_key").distinct()
    return csv_lines(b.valid, keys, b.block_heads)


#: A rule whose header has two columns, for rows that may hold any two of five.
TWO_OF_FIVE = ("/events", "1.0.0", ["_", "."], ["first", "second"], [0, 1], [2], 0, 0)


@query
def header_mismatch(spark, sf_dir):
    """Folders whose CSV is not as wide as its header."""
    b = build_blocks(written(derived.events_listing(_t(spark, sf_dir))), rules_frame(spark, [TWO_OF_FIVE]))
    return header_widths(b.grouping.valid_cells, b.block_heads)


EDITED = "/messy/f1"


@query
def folder_files(spark, sf_dir):
    """CSV files and invalid lists of all folders, written; then the names of one
    folder change, only its files are written again, and all are read back."""
    out, stamp = scratch_path(spark, "folder-files"), PUBLISHED_AT
    before = written(kept(derived.messy_listing(_t(spark, sf_dir))))
    after = written(before.where((F.col("folder_path") != EDITED) | ~F.col("name").contains("notes")))
    changed = spark.createDataFrame([(EDITED,)], "folder_path string")
    target = None
    for listing, only in ((before, None), (after.where(F.col("folder_path") == EDITED), changed)):
        b = build_blocks(listing, rules_frame(spark))
        write_csv(csv_lines(b.valid, b.grouping.valid_cells.select("folder_path", "col_key").distinct(), b.block_heads), f"{out}/csv", changed=only)
        target = write_invalid(b.grouping.invalid_files(), out, stamp, changed=only)
    return (read_lines(spark, f"{out}/csv").withColumn("kind", F.lit("csv"))
            .unionByName(read_lines(spark, target).withColumn("kind", F.lit("invalid"))))


@query
def dump_files(spark, sf_dir):
    """The text dump of the published blocks, written and read back."""
    out = scratch_path(spark, "dump")
    b = build_blocks(written(derived.runs_listing(_t(spark, sf_dir))), rules_frame(spark), valid_only=True)
    write_dump(json_dump(b.block_rows, b.block_heads), out)
    return spark.read.text(out).select(F.col("value").alias("json"))


# ------------------------------------------------ versioning and jobs

@query
def version_gate(spark, sf_dir):
    """Clients' stamps against a block set published at the stamp of the client
    with the least id; a client that has nothing yet comes with no stamp."""
    e = _t(spark, sf_dir).events
    clients = e.groupBy("user_id").agg(F.max("ts").alias("client_updated_at"))
    clients = clients.unionByName(clients.agg((F.max("user_id") + 1).alias("user_id"), F.lit(None).cast("timestamp_ntz").alias("client_updated_at")))
    published = clients.agg(F.min_by("client_updated_at", "user_id")).first()[0]
    status = gate_status(F.col("client_updated_at"), published)
    return clients.select(F.col("user_id").alias("client_id"), "client_updated_at",
                          status.alias("status"), (status == "no_update").alias("no_update"))


@query
def diff_all(spark, sf_dir):
    t = _t(spark, sf_dir)
    folders, files = _stored_old(t)
    new = derived.docs_new(t)
    diff = diff_pass(new, folders, files)
    is_folder = F.col("kind") == "folder"
    kind = F.when(~is_folder, F.col("change_type")).when(F.col("folder_id") == 0, "new").otherwise("changed")
    return diff.select(
        "kind", kind.alias("change_type"), F.when(is_folder, F.col("path")).otherwise(F.col("folder_path")).alias("folder_path"), "name",
        F.when(is_folder, F.col("disk_total_size")).otherwise(F.col("disk_size")).alias("disk_size"),
        F.when(is_folder, F.col("db_total_size")).otherwise(F.col("db_size")).alias("db_size"))


@query
def folder_names(spark, sf_dir):
    """The files that a diff of all folders sees, in each folder's order."""
    new = kept(derived.docs_new(_t(spark, sf_dir))).select("folder_path", "name")
    return ranged_index(new, ["folder_path"], ["name"], out="ord")


def _read_back(store: VersionedStore) -> DataFrame:
    """Files, folder totals and block rows of the current version, long."""
    folders = store.read("folders").select(F.lit("folder").alias("kind"), F.col("path").alias("folder_path"), F.lit(None).cast("string").alias("name"),
                                           "total_size", "file_count")
    files = store.read("files").select(F.lit("file").alias("kind"), "folder_path", "name", F.col("size").alias("total_size"),
                                       F.lit(None).cast("bigint").alias("file_count"))
    blocks = long_cells(store.read("block_rows")).select(F.lit("block").alias("kind"), F.col("block_id").alias("folder_path"), "name",
                                                         F.col("row_number").alias("total_size"), F.lit(None).cast("bigint").alias("file_count"))
    return folders.unionByName(files).unionByName(blocks)


@query
def sync_emptied_folder(spark, sf_dir):
    """The files of one language go, its folders stay: they are synced as
    empty, their files and blocks are gone."""
    t = _t(spark, sf_dir)
    store = VersionedStore(spark, scratch_path(spark, "emptied"))
    before = derived.docs_all(t)
    run_sync(store, before, rules_frame(spark), updated_at=PUBLISHED_AT)
    after = before.where(~F.col("folder_path").like("%/en"))
    run_sync(store, after, rules_frame(spark), updated_at=PUBLISHED_AT + dt.timedelta(days=1), folders=before.select("folder_path").distinct())
    return _read_back(store)


@query
def sync_vanished_folder(spark, sf_dir):
    """All folders of one language vanish. By default they keep their files and
    blocks and are not reported; with ``detect_removed`` they go. ``run`` tells the
    two apart."""
    t = _t(spark, sf_dir)
    out = []
    for run, detect in (("default", False), ("detect_removed", True)):
        store = VersionedStore(spark, scratch_path(spark, "vanished"))
        before = derived.docs_all(t)
        run_sync(store, before, rules_frame(spark), updated_at=PUBLISHED_AT)
        status = run_sync(store, before.where(~F.col("folder_path").like("%/en")), rules_frame(spark),
                          updated_at=PUBLISHED_AT + dt.timedelta(days=1), detect_removed=detect)
        status = status.select(F.lit("status").alias("kind"), F.lit(None).cast("string").alias("folder_path"), F.col("updated").cast("string").alias("name"),
                               F.col("folder_diffs").alias("total_size"), F.col("file_changes").alias("file_count"))
        out.append(_read_back(store).unionByName(status).withColumn("run", F.lit(run)))
    return out[0].unionByName(out[1])


@query
def sync_rule_edit(spark, sf_dir):
    """The corpus rule is edited under the same version: with a second column
    expected, no row is complete any more."""
    t = _t(spark, sf_dir)
    store = VersionedStore(spark, scratch_path(spark, "edited"))
    run_sync(store, derived.docs_all(t), rules_frame(spark), updated_at=PUBLISHED_AT)
    edited = [(*rule[:3], ["txt", "csv"], *rule[4:]) if rule[0] == "/corpus" else rule for rule in FIXTURE_RULES]
    run_sync(store, derived.docs_all(t), rules_frame(spark, edited), updated_at=PUBLISHED_AT + dt.timedelta(days=1))
    return _read_back(store).unionByName(store.read("block_heads").select(
        F.lit("head").alias("kind"), F.col("block_id").alias("folder_path"), _joined("column_headers").alias("name"),
        F.col("n_rows").alias("total_size"), F.lit(None).cast("bigint").alias("file_count")))


@query
def sync_excluded(spark, sf_dir):
    """A sync that excludes folders by name and files by pattern."""
    t = _t(spark, sf_dir)
    store = VersionedStore(spark, scratch_path(spark, "excluded"))
    skip = {"folder_exclusions": ("en",), "file_exclusions": ("doc_10.txt", "*.json")}
    run_sync(store, derived.docs_old(t), rules_frame(spark), updated_at=PUBLISHED_AT, **skip)
    run_sync(store, derived.docs_new(t), rules_frame(spark), updated_at=PUBLISHED_AT + dt.timedelta(days=1), detect_removed=True, **skip)
    return _read_back(store)


@query
def sync_forced(spark, sf_dir):
    """A forced sync of an unchanged listing writes the next version."""
    t = _t(spark, sf_dir)
    store = VersionedStore(spark, scratch_path(spark, "forced"))
    first = run_sync(store, derived.docs_all(t), rules_frame(spark), updated_at=PUBLISHED_AT)
    second = run_sync(store, derived.docs_all(t), rules_frame(spark), updated_at=PUBLISHED_AT + dt.timedelta(days=1), force=True)
    return first.unionByName(second)


@query
def sync(spark, sf_dir):
    t = _t(spark, sf_dir)
    rules = rules_frame(spark)
    store = VersionedStore(spark, scratch_path(spark, "sync"))
    first = run_sync(store, derived.docs_old(t), rules, updated_at=PUBLISHED_AT)
    second = run_sync(store, derived.docs_new(t), rules, updated_at=PUBLISHED_AT + dt.timedelta(days=1))
    third = run_sync(store, derived.docs_new(t), rules, updated_at=PUBLISHED_AT + dt.timedelta(days=2))
    return first.unionByName(second).unionByName(third)
