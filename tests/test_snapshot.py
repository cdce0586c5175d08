"""Snapshot diff / apply / store / sync / gate."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import apply as dml
from tessera.operators.diff import change_summary, file_changes, folder_diff
from tessera.operators.stats import folder_stats, stat_drift, stats_refresh
from tessera.functions.names import format_time
from tessera.plans.sync import get_datablock, initial_load, sync
from tessera.sources import derived
from tessera.sources.rules import rules_frame
from tessera.sources.store import VersionedStore
from tessera.sources.tables import Tables

from conftest import SF_SMALL


def L(spark, rows):
    return spark.createDataFrame(rows, "folder_path string, name string, size long")


def test_change_types(spark):
    old = L(spark, [("/a", "x", 1), ("/a", "y", 2), ("/a", "z", 3), ("/gone", "q", 9)])
    new = L(spark, [("/a", "x", 1), ("/a", "y", 5), ("/a", "w", 7), ("/b", "n", 4)])
    folders, files = dml.initial_snapshot(old)
    ch = {(r["change_type"], r["folder_path"], r["name"]): (r["disk_size"], r["db_size"])
          for r in file_changes(new, files).collect()}
    # files of folders no longer on disk are not reported by default
    assert ch == {("modified", "/a", "y"): (5, 2), ("removed", "/a", "z"): (0, 3),
                  ("added", "/a", "w"): (7, 0), ("added", "/b", "n"): (4, 0)}
    ch2 = file_changes(new, files, detect_removed=True)
    assert ch2.where((F.col("name") == "q") & (F.col("change_type") == "removed")).count() == 1
    fd = {r["path"]: (r["folder_id"], r["disk_total_size"], r["db_total_size"])
          for r in folder_diff(folder_stats(new), folders).collect()}
    assert fd["/b"][0] == 0 and fd["/a"][1:] == (13, 6)
    summary = {r["kind"]: r["n"] for r in change_summary(folder_diff(folder_stats(new), folders),
                                                         file_changes(new, files)).collect()}
    assert summary == {"folder_new": 1, "folder_changed": 1, "added": 2, "modified": 1, "removed": 1, "folder_removed": 0}


def test_round_trip_on_corpus(spark):
    t = Tables(spark, SF_SMALL)
    old, new = derived.docs_old(t), derived.docs_new(t)
    folders, files = dml.initial_snapshot(old)
    fd = folder_diff(folder_stats(new), folders, detect_removed=True)
    ch = file_changes(new, files, detect_removed=True)
    new_folders = dml.apply_folder_diffs(folders, fd)
    applied = dml.apply_file_changes(files, ch, new_folders)
    got = {(r[0], r[1], r[2]) for r in applied.select("folder_path", "name", "size").collect()}
    want = {(r[0], r[1], r[2]) for r in new.collect()}
    assert got == want
    ids = [r["id"] for r in applied.collect()]
    assert len(ids) == len(set(ids))
    # every file points at the folder row of its path
    assert applied.join(new_folders, (applied.folder_id == new_folders.id)
                        & (applied.folder_path == new_folders.path), "left_anti").count() == 0


def test_unknown_change_type_fails(spark):
    files = spark.createDataFrame([(1, 1, "/a", "x", 1)], "id long, folder_id long, folder_path string, name string, size long")
    folders = spark.createDataFrame([(1, "/a", 1, 1)], "id long, path string, total_size long, file_count long")
    bad = spark.createDataFrame([("renamed", 1, 1, "/a", "x", 2, 1)],
                                "change_type string, file_id long, folder_id long, folder_path string, name string, disk_size long, db_size long")
    with pytest.raises(Exception, match="unknown change type"):
        dml.apply_file_changes(files, bad, folders).collect()


def test_insert_if_absent_and_cascade(spark):
    old = L(spark, [("/a", "x", 1)])
    new = L(spark, [("/a", "x", 99), ("/a", "y", 2)])
    got = {(r[1], r[2]) for r in dml.insert_if_absent(old, new, ["folder_path", "name"]).collect()}
    assert got == {("x", 1), ("y", 2)}
    folders, files = dml.initial_snapshot(L(spark, [("/a", "x", 1), ("/b", "y", 2)]))
    kept = folders.where(F.col("path") == "/a")
    assert [r["name"] for r in dml.cascade_delete(files, kept).collect()] == ["x"]


def test_stats_refresh_and_drift(spark):
    folders = spark.createDataFrame([(1, "/a", 10, 2), (2, "/empty", 5, 1)],
                                    "id long, path string, total_size long, file_count long")
    files = spark.createDataFrame([(1, 1, "/a", "x", 4), (2, 1, "/a", "y", 6)],
                                  "id long, folder_id long, folder_path string, name string, size long")
    ref = {r["path"]: (r["total_size"], r["file_count"]) for r in stats_refresh(folders, files).collect()}
    assert ref == {"/a": (10, 2), "/empty": (0, 0)}
    assert [r["path"] for r in stat_drift(folders, files).collect()] == ["/empty"]


def test_sync_versions_and_gate(spark, tmpdir_path):
    t = Tables(spark, SF_SMALL)
    rules = rules_frame(spark)
    store = VersionedStore(spark, tmpdir_path + "/store")
    s0 = dt.datetime(2024, 1, 1)
    r0 = sync(store, derived.docs_old(t), rules, updated_at=s0).first()
    assert r0["updated"] and r0["version"] == 0
    r1 = sync(store, derived.docs_new(t), rules, updated_at=s0 + dt.timedelta(days=1)).first()
    assert r1["updated"] and r1["version"] == 1 and r1["file_changes"] > 0
    r2 = sync(store, derived.docs_new(t), rules, updated_at=s0 + dt.timedelta(days=2)).first()
    assert not r2["updated"] and r2["version"] == 1
    r3 = sync(store, derived.docs_new(t), rules, force=True, updated_at=s0 + dt.timedelta(days=3)).first()
    assert r3["updated"] and r3["version"] == 2
    # folders gone from disk are kept by default (never reported); the live
    # folders hold exactly the new listing
    live = derived.docs_new(t).select("folder_path").distinct()
    files = store.read("files").join(live, "folder_path", "left_semi")
    assert {(r[0], r[1], r[2]) for r in files.select("folder_path", "name", "size").collect()} == \
        {(r[0], r[1], r[2]) for r in derived.docs_new(t).collect()}
    # gate: older client gets the set, same stamp gets nothing, newer is an error
    heads, rows, no_update = get_datablock(store, s0)
    assert not no_update and heads.count() > 0 and rows.count() > 0
    assert get_datablock(store, s0 + dt.timedelta(days=3))[2] is True
    with pytest.raises(ValueError, match="newer"):
        get_datablock(store, s0 + dt.timedelta(days=9))
    # one block read back by id
    some = rows.select("block_id").first()[0]
    assert store.read_block(some).where(F.col("block_id") != some).count() == 0


def test_sync_detect_removed(spark, tmpdir_path):
    t = Tables(spark, SF_SMALL)
    rules = rules_frame(spark)
    store = VersionedStore(spark, tmpdir_path + "/store")
    sync(store, derived.docs_old(t), rules, updated_at=dt.datetime(2024, 1, 1))
    sync(store, derived.docs_new(t), rules, updated_at=dt.datetime(2024, 1, 2), detect_removed=True)
    got = {(r[0], r[1], r[2]) for r in store.read("files").select("folder_path", "name", "size").collect()}
    assert got == {(r[0], r[1], r[2]) for r in derived.docs_new(t).collect()}
    paths = {r[0] for r in store.read("folders").select("path").collect()}
    assert paths == {r[0] for r in derived.docs_new(t).select("folder_path").distinct().collect()}


def test_clear_publishes_empty_version(spark, tmpdir_path):
    t = Tables(spark, SF_SMALL)
    store = VersionedStore(spark, tmpdir_path + "/store")
    sync(store, derived.docs_old(t), rules_frame(spark), updated_at=dt.datetime(2024, 1, 1))
    v = store.clear(dt.datetime(2024, 1, 2))
    assert v == 1 and store.read("files").count() == 0 and store.read("folders").count() == 0
    assert store.read("files", 0).count() > 0


def test_mtime_comparison_sees_same_size_edits(spark):
    old = spark.createDataFrame([("/a", "x", 5, dt.datetime(2024, 1, 1)), ("/a", "y", 3, dt.datetime(2024, 1, 1))],
                                "folder_path string, name string, size long, mtime timestamp_ntz")
    new = spark.createDataFrame([("/a", "x", 5, dt.datetime(2024, 2, 1)), ("/a", "y", 3, dt.datetime(2024, 1, 1)),
                                 ("/a", "z", 1, dt.datetime(2024, 2, 2))],
                                "folder_path string, name string, size long, mtime timestamp_ntz")
    folders, files = dml.initial_snapshot(old)
    assert "mtime" in files.columns
    assert file_changes(new, files).count() == 1  # size only: the same-size edit is invisible
    ch = file_changes(new, files, compare=("size", "mtime"))
    assert {(r["change_type"], r["name"]) for r in ch.collect()} == {("modified", "x"), ("added", "z")}
    applied = dml.apply_file_changes(files, ch, folders)
    got = {(r["name"], r["size"], r["mtime"]) for r in applied.collect()}
    assert got == {(r["name"], r["size"], r["mtime"]) for r in new.collect()}


def test_emptied_folder_is_synced(spark, tmpdir_path):
    rules = rules_frame(spark, [("/data", "1", ["_", "."], ["A"], [0], [1], 0, 0)])
    store = VersionedStore(spark, tmpdir_path + "/store")
    both = L(spark, [("/data/a", "x_A.txt", 1), ("/data/b", "y_A.txt", 2)])
    folders = both.select("folder_path")
    sync(store, both, rules, folders=folders, updated_at=dt.datetime(2024, 1, 1))
    assert store.read("block_heads").count() == 2
    status = sync(store, both.where("folder_path = '/data/a'"), rules, folders=folders, updated_at=dt.datetime(2024, 1, 2)).first()
    assert status["updated"] and status["file_changes"] == 1
    assert [r["name"] for r in store.read("files").collect()] == ["x_A.txt"]
    assert {(r["path"], r["total_size"], r["file_count"]) for r in store.read("folders").collect()} == {("/data/a", 1, 1), ("/data/b", 0, 0)}
    # an emptied folder that still exists is not a vanished one
    sync(store, both.where("folder_path = '/data/a'"), rules, folders=folders, detect_removed=True, force=True, updated_at=dt.datetime(2024, 1, 3))
    assert store.read("folders").count() == 2


def test_rule_edit_rebuilds_blocks(spark, tmpdir_path):
    store = VersionedStore(spark, tmpdir_path + "/store")
    lst = L(spark, [("/data/a", n, 1) for n in ("s_R1.txt", "t_R1.txt")])
    two = rules_frame(spark, [("/data", "1", ["_", "."], ["R1", "R2"], [0], [1], 0, 0)])
    one = rules_frame(spark, [("/data", "1", ["_", "."], ["R1"], [0], [1], 0, 0)])
    sync(store, lst, two, updated_at=dt.datetime(2024, 1, 1))
    assert store.read("block_rows").count() == 0
    assert sync(store, lst, one, updated_at=dt.datetime(2024, 1, 2)).first()["updated"]
    assert store.read("block_heads").first()["column_headers"] == ["R1"] and store.read("block_rows").count() == 2
    assert not sync(store, lst, one, updated_at=dt.datetime(2024, 1, 3)).first()["updated"]


def test_committed_versions_are_never_overwritten(spark, tmpdir_path):
    store = VersionedStore(spark, tmpdir_path + "/store")
    rules = rules_frame(spark)
    lst = L(spark, [("/data/a", "x", 1)])
    sync(store, lst, rules, updated_at=dt.datetime(2024, 1, 1))
    with pytest.raises(FileExistsError):
        initial_load(store, lst, rules)
    with pytest.raises(FileExistsError):
        store.commit({"folders": store.read("folders")}, dt.datetime(2024, 1, 2), version=0)


def test_created_time_stays_and_is_formatted(spark):
    t = Tables(spark, SF_SMALL)
    old, new = derived.docs_old(t), derived.docs_new(t)
    folders, files = dml.initial_snapshot(old)
    upserted = dml.apply_folder_diffs(folders, folder_diff(folder_stats(new), folders))
    applied = dml.apply_file_changes(files, file_changes(new, files), upserted)
    live = new.select("folder_path").distinct()
    got = applied.join(live, "folder_path", "left_semi").select("folder_path", "name", "created_time")
    assert got.exceptAll(new.select("folder_path", "name", "created_time")).isEmpty()
    assert upserted.where("created_time is null").isEmpty()
    first = new.orderBy("created_time").select(format_time("created_time").alias("t")).first()
    assert first["t"].startswith("2020-01-01 00:")
