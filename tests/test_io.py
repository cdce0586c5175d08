"""Sources and sinks on real files: binaryFile listing, rule.json, CSV,
invalid lists, nested export, entry contract."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from conftest import SF_SMALL
from tessera.registry import QUERIES
from tessera.operators.blocks import datablock, merge_blocks, override_headers
from tessera.operators.stats import folder_stats
from tessera.plans.build import build_blocks
from tessera.sinks.files import csv_lines, header_widths, json_dump, read_lines, write_csv, write_dump, write_invalid
from tessera.sources.listing import listing_from_dir, scan_files
from tessera.sources.rules import load_rules_json, rules_frame


CHEAP = ("folder_scan", "glob_search", "rules_by_folder", "files_for_folder", "folder_diff", "file_changes", "change_summary", "rule_conflicts",
         "invalid_files", "cell_collisions", "block_rejects", "stat_drift", "fileblock_dump", "header_mismatch", "folder_totals_incremental")


def make_tree(root, n_dirs=5, n_files=10, rule=None):
    for i in range(n_dirs):
        d = os.path.join(root, f"dir_{i}")
        os.makedirs(d)
        for j in range(n_files):
            with open(os.path.join(d, f"file_{j}.txt"), "w") as f:
                f.write(f"Content of file {j} in directory {i}")
        if rule is not None:
            with open(os.path.join(d, "rule.json"), "w") as f:
                json.dump(rule, f)


def test_listing_from_dir_and_stats(spark, tmpdir_path):
    make_tree(tmpdir_path, rule={})
    lst = listing_from_dir(spark, tmpdir_path)
    kept = scan_files(lst)
    stats = {r["folder_path"]: (r["total_size"], r["file_count"]) for r in folder_stats(kept).collect()}
    assert len(stats) == 5
    want_size = sum(len(f"Content of file {j} in directory 0") for j in range(10))
    assert stats[os.path.join(tmpdir_path, "dir_0")] == (want_size, 10)
    assert "content" not in lst.schema.fieldNames()


def test_rule_json_loading(spark, tmpdir_path):
    make_tree(tmpdir_path, n_dirs=2, n_files=2,
              rule={"version": "1.0.1", "delimiter": ["_", "."], "header": ["txt"],
                    "rowRules": {"matchParts": [1]}, "columnRules": {"matchParts": [2]},
                    "sizeRules": {"minSize": 1, "maxSize": 100}})
    os.makedirs(os.path.join(tmpdir_path, "empty_rule"))
    with open(os.path.join(tmpdir_path, "empty_rule", "rule.json"), "w") as f:
        f.write("{}")
    rules = {r["folder_prefix"]: r for r in load_rules_json(spark, tmpdir_path + "/*/rule.json").collect()}
    r = rules[os.path.join(tmpdir_path, "dir_0")]
    assert r["delimiter"] == ["_", "."] and r["row_parts"] == [1] and r["max_size"] == 100
    e = rules[os.path.join(tmpdir_path, "empty_rule")]
    assert e["header"] == [] and e["row_parts"] == []
    b = build_blocks(scan_files(listing_from_dir(spark, tmpdir_path)), load_rules_json(spark, tmpdir_path + "/*/rule.json"))
    assert {r["n_rows"] for r in b.block_heads.collect()} == {2}


def test_csv_and_invalid_sinks(spark, tmpdir_path):
    lst = spark.createDataFrame([("/x", n, 1) for n in ["a_A.txt", "a_B.txt", "c_A.txt", "c_B.txt", "e_A.txt"]],
                                "folder_path string, name string, size long")
    rs = rules_frame(spark, [("/x", "1", ["_", "."], ["A", "B"], [0], [1], 0, 0)])
    b = build_blocks(lst, rs)
    lines = {r["line_no"]: r["line"] for r in csv_lines(b.valid, b.grouping.column_keys(), b.block_heads).collect()}
    assert lines == {0: "Row,A,B", 1: "Row0,a_A.txt,a_B.txt", 2: "Row1,c_A.txt,c_B.txt"}
    write_csv(csv_lines(b.valid, b.grouping.column_keys(), b.block_heads), tmpdir_path + "/csv")
    text = spark.read.text(tmpdir_path + "/csv").collect()
    assert len(text) == 3
    write_invalid(b.grouping.invalid_files(), tmpdir_path + "/inv")
    assert [r[0] for r in spark.read.text(tmpdir_path + "/inv").collect()] == ["e_A.txt"]


def test_changed_folders_are_replaced(spark, tmpdir_path):
    """Files of changed folders are overwritten, a list without names any more goes,
    and the files of other folders are the same as before."""
    rs = rules_frame(spark, [("/x", "1", ["_", "."], ["A", "B"], [0], [1], 0, 0)])

    def put(names, changed):
        rows = [(d, n, 1) for d, ns in names.items() for n in ns]
        b = build_blocks(spark.createDataFrame(rows, "folder_path string, name string, size long"), rs)
        only = None if changed is None else spark.createDataFrame([(d,) for d in changed], "folder_path string")
        write_csv(csv_lines(b.valid, b.grouping.column_keys(), b.block_heads), tmpdir_path + "/csv", changed=only)
        return write_invalid(b.grouping.invalid_files(), tmpdir_path, dt.datetime(2024, 1, 2, 3, 4, 5), changed=only)

    target = put({"/x/a b": ["p_A.txt", "p_B.txt", "q_A.txt"], "/x/c": ["r_A.txt"], "/x/gone": ["s_A.txt"]}, None)
    assert target.endswith("/invalid_files_20240102030405")
    other = {f for f in read_lines(spark, tmpdir_path + "/csv").inputFiles() if "Fx%252Fc/" in f}
    put({"/x/a b": ["p_A.txt", "p_B.txt"], "/x/c": ["ignored_A.txt"]}, ["/x/a b", "/x/gone"])
    assert {tuple(r) for r in read_lines(spark, target).collect()} == {("/x/c", "r_A.txt")}
    lines = {tuple(r) for r in read_lines(spark, tmpdir_path + "/csv").collect()}
    assert lines == {("/x/a b", "Row,A,B"), ("/x/a b", "Row0,p_A.txt,p_B.txt"), ("/x/c", "Row,A,B")}
    assert other and other <= set(read_lines(spark, tmpdir_path + "/csv").inputFiles())


def test_header_widths_and_dump_files(spark, tmpdir_path):
    lst = spark.createDataFrame([("/x", n, 1) for n in ["a_A.txt", "a_B.txt", "c_A.txt", "c_C.txt"]] + [("/x/y", n, 1) for n in ["a_A.txt", "a_B.txt"]],
                                "folder_path string, name string, size long")
    b = build_blocks(lst, rules_frame(spark, [("/x", "1", ["_", "."], ["A", "B"], [0], [1], 0, 0)]))
    assert [tuple(r) for r in header_widths(b.grouping.valid_cells, b.block_heads).collect()] == [("/x", 2, 3)]
    write_dump(json_dump(b.block_rows, b.block_heads), tmpdir_path + "/dump")
    lines = [json.loads(r[0]) for r in spark.read.text(tmpdir_path + "/dump").collect()]
    assert len(lines) == 5 and sum("column_headers" in x for x in lines) == 2


def test_odd_folder_names_and_malformed_rules(spark, tmpdir_path):
    """Folders whose names a URI encodes, and a rule file that is not JSON."""
    names = ["my run 1", "a#b", "50%", "x+y"]
    rule = {"version": "1", "delimiter": ["_", "."], "header": ["A", "B"], "rowRules": {"matchParts": [0]}, "columnRules": {"matchParts": [1]}}
    for n in [*names, "broken"]:
        os.makedirs(os.path.join(tmpdir_path, n))
        for f in ("a_A.txt", "a_B.txt"):
            open(os.path.join(tmpdir_path, n, f), "w").close()
        with open(os.path.join(tmpdir_path, n, "rule.json"), "w") as f:
            f.write(json.dumps(rule) if n != "broken" else json.dumps(rule)[:40])
    paths = [os.path.join(tmpdir_path, n) for n in [*names, "broken"]]
    lst = spark.createDataFrame([(p, f, 0) for p in paths for f in ("a_A.txt", "a_B.txt")], "folder_path string, name string, size long")
    rules = load_rules_json(spark, [os.path.join(p, "rule.json") for p in paths])
    b = build_blocks(lst, rules)
    assert {r["block_id"]: r["n_rows"] for r in b.block_heads.collect()} == dict.fromkeys(paths[:-1], 1)
    assert [(r["folder_path"], r["reason"]) for r in b.rejects.collect()] == [(paths[-1], "invalid rule")]


def test_rule_prefixes(spark):
    """Trailing slashes go, the root is everyone's ancestor, and a prefix named
    twice is reported."""
    lst = spark.createDataFrame([(d, f"a_{c}.txt", 1) for d in ("/data/x", "/twice", "/other/y") for c in "AB"], "folder_path string, name string, size long")
    rule = ("1", ["_", "."], ["A", "B"], [0], [1], 0, 0)
    b = build_blocks(lst, rules_frame(spark, [("/data/",) + rule, ("/twice",) + rule, ("/twice/",) + rule, ("/",) + rule]))
    assert {r["block_id"]: r["n_rows"] for r in b.block_heads.collect()} == {"/data/x": 1, "/other/y": 1}
    assert [tuple(r) for r in b.rejects.collect()] == [("/twice", "invalid rule")]


def test_one_rule_per_folder_under_a_top_rule(spark):
    rule = ("1", ["_", "."], ["A", "B"], [0], [1], 0, 0)
    rules = rules_frame(spark, [("/top",) + rule] + [(f"/top/f{i}", str(i)) + rule[1:] for i in range(2000)])
    lst = spark.range(2100).selectExpr("concat('/top/f', id) as folder_path", "explode(array('a_A.txt', 'a_B.txt')) as name", "1L as size")
    got = {r["block_id"]: (r["rule_version"], r["n_rows"]) for r in build_blocks(lst, rules).block_heads.collect()}
    assert got == {f"/top/f{i}": (str(i) if i < 2000 else "1", 1) for i in range(2100)}


def test_dump_merge_and_guards(spark):
    lst = spark.createDataFrame([("/x", n, 1) for n in ["a_A.txt", "a_B.txt", "c_A.txt", "c_B.txt"]],
                                "folder_path string, name string, size long")
    b = build_blocks(lst, rules_frame(spark, [("/x", "1", ["_", "."], ["A", "B"], [0], [1], 0, 0)]))
    dump = [json.loads(r["json"]) for r in json_dump(b.block_rows, b.block_heads).orderBy("line_no").collect()]
    assert dump[0] == {"block_id": "/x", "column_headers": ["A", "B"]}
    assert dump[1] == {"row_number": 0, "cell_columns": {"A": "a_A.txt", "B": "a_B.txt"}} and len(dump) == 3
    assert json_dump(b.block_rows, b.block_heads, "/y").count() == 0
    other = b.block_heads.withColumn("column_headers", F.array(F.lit("Z"))), b.block_rows.limit(0)
    heads, rows = merge_blocks([(b.block_heads, b.block_rows), other])
    assert heads.first()["column_headers"] == ["Z"] and heads.count() == 1 and rows.count() == 0
    with pytest.raises(ValueError, match="empty block set"):
        datablock(b.block_heads.limit(0), "2024-01-01 00:00:00")
    assert override_headers(b.block_heads, ["L", "R"]).first()["column_headers"] == ["L", "R"]


def test_entry_contract(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["folder_path", "row_number", "row_key", "R1", "R2"]
    assert df.count() > 0
    qs, oracle = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(oracle) <= set(qs)
    assert set(QUERIES) <= set(oracle)
    assert len(QUERIES) >= 60


def test_every_registered_query_has_rows(spark):
    """No query passes by comparing nothing with nothing."""
    empty = [name for name, fn in QUERIES.items() if name in CHEAP and fn(spark, SF_SMALL).isEmpty()]
    assert not empty
    status = {r["status"] for r in QUERIES["version_gate"](spark, SF_SMALL).collect()}
    assert status == {"send", "no_update", "error"}
    rejects = {r["reject"] for r in QUERIES["folder_id_lookup"](spark, SF_SMALL).collect()}
    assert rejects == {None, "no stored folder"}
    assert all(r["rows_before"] > 0 and r["rows_after"] == 0 for r in QUERIES["clear_snapshot"](spark, SF_SMALL).collect())
