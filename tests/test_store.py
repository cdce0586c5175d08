"""The bucketed store: what a commit writes and reads, two writers, vanished
folders, and the one-pass diff."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import apply as dml
from tessera.operators.diff import diff_digest, diff_pass, file_changes, folder_diff, of_kind
from tessera.operators.stats import folder_stats, stats_refresh, totals_by_changes
from tessera.plans import sync as sync_module
from tessera.plans.sync import sync
from tessera.sources import derived
from tessera.sources.rules import rules_frame
from tessera.sources.store import TABLES, ConcurrentCommit, VersionedStore
from tessera.sources.tables import Tables

from conftest import SF_SMALL

RULES = [("/data", "1", ["_", "."], ["A"], [0], [1], 0, 0)]
DAY = [dt.datetime(2024, 1, d) for d in range(1, 9)]


def L(spark, rows):
    return spark.createDataFrame(rows, "folder_path string, name string, size long")


def many(spark, n=20):
    return L(spark, [(f"/data/d{i}", f"{x}_A.txt", i) for i in range(n) for x in "xy"])


def files_of(store, table, version):
    return {f for f in store.read(table, version).inputFiles()}


def content(store):
    return [sorted((tuple(r) for r in store.read(t).drop("id", "folder_id", "cells").collect()), key=repr) for t in TABLES]


def test_a_change_of_one_folder_writes_one_bucket(spark, tmpdir_path):
    store = VersionedStore(spark, tmpdir_path + "/store", buckets=8)
    lst = many(spark)
    sync(store, lst, rules_frame(spark, RULES), updated_at=DAY[0])
    before = {t: files_of(store, t, 0) for t in TABLES}
    after = lst.unionByName(L(spark, [("/data/d7", "z_A.txt", 5)]))
    status = sync(store, after, rules_frame(spark, RULES), updated_at=DAY[1]).first()
    assert (status["folder_diffs"], status["file_changes"], status["blocks"]) == (1, 1, 20)
    mine = store.buckets_of(L(spark, [("/data/d7", "", 0)]))
    for t in TABLES:
        now = files_of(store, t, 1)
        old = {f for f in before[t] if f"/bucket={mine[0]}/" not in f}
        assert len(old) >= 4 and old <= now
        assert all(f"/bucket={mine[0]}/" in f and "/v=1-" in f for f in now - old)
    # the same as a store that was loaded at once, but for the ids
    fresh = VersionedStore(spark, tmpdir_path + "/fresh", buckets=3)
    sync(fresh, after, rules_frame(spark, RULES), updated_at=DAY[1])
    assert content(store) == content(fresh)
    ids = [r["id"] for r in store.read("files").collect()]
    assert len(ids) == len(set(ids)) == 41
    # nothing of the first version is lost, and an unchanged sync writes nothing
    assert store.read("files", 0).count() == 40
    assert not sync(store, after, rules_frame(spark, RULES), updated_at=DAY[2]).first()["updated"]
    # a forced one publishes the same files under a new stamp
    assert sync(store, after, rules_frame(spark, RULES), force=True, updated_at=DAY[3]).first()["version"] == 2
    assert files_of(store, "files", 2) == files_of(store, "files", 1) and store.current() == (2, DAY[3])


def test_one_block_reads_its_bucket_only(spark, tmpdir_path):
    store = VersionedStore(spark, tmpdir_path + "/store", buckets=8)
    sync(store, many(spark), rules_frame(spark, RULES), updated_at=DAY[0])
    read = store.read_block("/data/d7")
    assert {r["name"] for r in read.select(F.explode("entries.name").alias("name")).collect()} == {"x_A.txt", "y_A.txt"}
    assert len(read.inputFiles()) == 1 < len(store.read("block_rows").inputFiles())
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(block_id,/data/d7)" in plan
    assert store.read_block("/nowhere").count() == 0


def test_a_hot_folder_spans_files(spark, tmpdir_path):
    """A bucket is split by size, not kept in one task."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        store = VersionedStore(spark, tmpdir_path + "/store", buckets=4)
        lst = spark.range(60_000).selectExpr("'/data/hot' as folder_path", "concat('f', id, '_A.txt') as name", "id as size")
        folders, files = dml.initial_snapshot(lst)
        store.commit({"folders": folders, "files": files}, DAY[0])
        assert len(store.read("files").inputFiles()) > 1 and store.read("files").count() == 60_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_two_writers(spark, tmpdir_path, monkeypatch):
    """A second writer's commit in the middle of a sync: folders in other buckets
    are taken over, the same bucket is refused."""
    rules = rules_frame(spark, RULES)
    start = many(spark, 6)
    place = {r[0]: r[1] for r in start.select("folder_path", VersionedStore(spark, tmpdir_path + "/apart", buckets=8).bucket("folder_path")).collect()}
    apart = next(d for d in sorted(place) if place[d] != place["/data/d1"])
    one, two = (start.unionByName(L(spark, [(d, "new_A.txt", 1)])) for d in ("/data/d1", apart))
    same = start.unionByName(L(spark, [("/data/d1", "other_A.txt", 1)]))
    real = sync_module.incremental_blocks

    def interleaved(store, second):
        done = []

        def build(*args, **kwargs):
            if not done:
                done.append(1)
                sync(store, second, rules, updated_at=DAY[1])
            return real(*args, **kwargs)
        return build

    store = VersionedStore(spark, tmpdir_path + "/apart", buckets=8)
    sync(store, start, rules, updated_at=DAY[0])
    monkeypatch.setattr(sync_module, "incremental_blocks", interleaved(store, two))
    # started again from the other's version, whose file its own listing doesn't have
    status = sync(store, one, rules, updated_at=DAY[2]).first()
    assert (status["version"], status["file_changes"]) == (2, 2)
    rows = store.read("files").collect()
    assert [r["folder_path"] for r in rows if r["name"] == "new_A.txt"] == ["/data/d1"] and len({r["id"] for r in rows}) == len(rows) == 13

    store = VersionedStore(spark, tmpdir_path + "/same", buckets=8)
    sync(store, start, rules, updated_at=DAY[0])
    monkeypatch.setattr(sync_module, "incremental_blocks", interleaved(store, same))
    with pytest.raises(ConcurrentCommit) as e:
        sync(store, one, rules, updated_at=DAY[2])
    assert e.value.buckets == set(store.buckets_of(L(spark, [("/data/d1", "", 0)])))
    assert store.current()[0] == 1 and store.read("files").where("name = 'other_A.txt'").count() == 1


def test_vanished_folder(spark, tmpdir_path):
    rules = rules_frame(spark, RULES)
    both = L(spark, [("/data/a", "x_A.txt", 1), ("/data/b", "y_A.txt", 2)])
    store = VersionedStore(spark, tmpdir_path + "/store")
    sync(store, both, rules, updated_at=DAY[0])
    left = both.where("folder_path = '/data/a'")
    assert not sync(store, left, rules, updated_at=DAY[1]).first()["updated"]
    # a change elsewhere keeps the vanished folder's block too
    changed = left.unionByName(L(spark, [("/data/a", "z_A.txt", 1)]))
    assert sync(store, changed, rules, updated_at=DAY[2]).first()["file_changes"] == 1
    assert {r[0] for r in store.read("block_heads").select("block_id").collect()} == {"/data/a", "/data/b"}
    assert store.read("block_rows").where("block_id = '/data/b'").count() == 1
    status = sync(store, changed, rules, updated_at=DAY[3], detect_removed=True).first()
    assert (status["folder_diffs"], status["file_changes"]) == (1, 1)
    assert {r[0] for r in store.read("block_heads").select("block_id").collect()} == {"/data/a"}
    assert store.read("files").where("folder_path = '/data/b'").count() == 0


def test_diff_pass_equals_its_parts_and_scans_the_listing_once(spark, tmpdir_path):
    t = Tables(spark, SF_SMALL)
    derived.docs_new(t).write.parquet(tmpdir_path + "/listing")
    new = spark.read.parquet(tmpdir_path + "/listing")
    folders, files = dml.initial_snapshot(derived.docs_old(t))
    for removed in (False, True):
        diff = diff_pass(new, folders, files, detect_removed=removed)
        rows = sorted(map(tuple, of_kind(diff, "folder").collect()), key=repr)
        assert rows == sorted(map(tuple, folder_diff(folder_stats(new), folders, removed).select(of_kind(diff, "folder").columns).collect()), key=repr)
        rows = sorted(map(tuple, of_kind(diff, "file").collect()), key=repr)
        assert rows == sorted(map(tuple, file_changes(new, files, removed).select(of_kind(diff, "file").columns).collect()), key=repr)
    scans = [x for x in diff_digest(new, files)._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and "/listing" in x]
    assert len(scans) == 1
    assert "/listing" not in diff_pass(new, folders, files)._jdf.queryExecution().executedPlan().toString()


def test_incremental_totals_equal_a_refresh(spark):
    t = Tables(spark, SF_SMALL)
    folders, files = dml.initial_snapshot(derived.docs_old(t))
    new = derived.docs_new(t)
    for removed in (False, True):
        changes = file_changes(new, files, removed)
        upserted = dml.apply_folder_diffs(folders, folder_diff(folder_stats(new), folders, removed))
        want = stats_refresh(upserted, dml.apply_file_changes(files, changes, upserted)).select("path", "total_size", "file_count")
        got = totals_by_changes(folders, changes)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_the_first_load_derives_its_listing_once(spark, tmpdir_path):
    read = spark.sparkContext.accumulator(0)
    rows = [(f"/data/d{i % 3}", f"{i}_A.txt", i) for i in range(40)]

    def seen(row):
        read.add(1)
        return row

    lst = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), "folder_path string, name string, size long")
    store = VersionedStore(spark, tmpdir_path + "/store")
    sync_module.initial_load(store, lst, rules_frame(spark, RULES), DAY[0])
    assert read.value == len(rows) == store.read("files").count()


def test_a_large_first_load_is_written_in_its_own_order(spark, tmpdir_path, monkeypatch):
    """Numbered tables are in order of their folders, so they aren't shuffled by bucket
    again; block rows keep their entries only, and are read with the map of them."""
    lst = many(spark)
    stores = []
    for name, least in (("small", 1 << 40), ("large", 1)):
        monkeypatch.setattr(sync_module, "ORDERED", least)
        hints, hint = [], type(lst).hint
        monkeypatch.setattr(type(lst), "hint", lambda df, *a: hints.append(a[0]) or hint(df, *a))
        store = VersionedStore(spark, f"{tmpdir_path}/{name}", buckets=8)
        sync_module.initial_load(store, lst, rules_frame(spark, RULES), DAY[0])
        monkeypatch.undo()
        stores.append((store, len(hints)))
    (small, four), (large, two) = stores
    assert (four, two) == (4, 2)
    for table in ("folders", "files", "block_heads"):
        assert sorted(map(str, small.read(table).collect())) == sorted(map(str, large.read(table).collect()))
    rows = large.read("block_rows")
    assert rows.columns == ["block_id", "row_number", "cells", "entries"]
    assert "cells" not in spark.read.parquet(*rows.inputFiles()).columns
    assert {(r["block_id"], r["row_number"], tuple(r["cells"].items())) for r in rows.collect()} == {
        (r["block_id"], r["row_number"], tuple(map(tuple, r["entries"]))) for r in small.read("block_rows").collect()}
