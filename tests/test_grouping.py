"""Rule-driven grouping: golden cases and a property test against a small
pure-Python model of the same semantics (used only here)."""

import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators.grouping import NameGrouping
from tessera.operators.indexing import ranged_index, window_index
from tessera.plans.build import build_blocks
from tessera.sources.rules import rules_frame

FASTQ = ("1.0.1", ["_", "."], ["R1", "R2"], [0, 1, 2, 4, 5, 6], [3], 100, 1048576)


def listing(spark, folder, names):
    return spark.createDataFrame([(folder, n, 1) for n in names], "folder_path string, name string, size long")


def rules(spark, *rows):
    return rules_frame(spark, list(rows))


def valid_set(g):
    return {(r["folder_path"], r["row_number"], tuple(sorted(r["cells"].items())))
            for r in g.valid_groups().collect()}


def test_incomplete_fastq_names(spark):
    names = ["sample1_S1_L001_R1_001.fastq.gz", "sample1_S1_L001_R2_001.fastq.gz",
             "sample13_S13_L001_R1.fastq.gz", "sample14_S14_L001_R2_001.fastq",
             "sample15_S15_L001_001.fastq.gz", "sample16_S16_L001.fastq.gz"]
    g = NameGrouping(listing(spark, "/d", names), rules(spark, ("/d",) + FASTQ))
    keys = {r["name"]: (r["row_key"], r["col_key"]) for r in g.keyed.collect()}
    assert keys["sample1_S1_L001_R1_001.fastq.gz"] == ("sample1_S1_L001_001_fastq_gz", "R1")
    assert keys["sample13_S13_L001_R1.fastq.gz"] == ("sample13_S13_L001_fastq_gz", "R1")
    assert keys["sample14_S14_L001_R2_001.fastq"] == ("sample14_S14_L001_001_fastq", "R2")
    assert keys["sample15_S15_L001_001.fastq.gz"] == ("sample15_S15_L001_fastq_gz", "001")
    assert keys["sample16_S16_L001.fastq.gz"] == ("sample16_S16_L001_gz", "fastq")
    assert g.rows.count() == 5
    v = g.valid_groups().collect()
    assert len(v) == 1 and v[0]["row_number"] == 0
    assert v[0]["cells"] == {"R1": "sample1_S1_L001_R1_001.fastq.gz", "R2": "sample1_S1_L001_R2_001.fastq.gz"}
    assert g.invalid_files().count() == 4


def test_complete_run_of_48(spark):
    names = [f"sample{s}_S{s}_L00{lane}_R{r}_001.fastq.gz"
             for s in range(1, 13) for lane in (1, 2) for r in (1, 2)]
    g = NameGrouping(listing(spark, "/d", names), rules(spark, ("/d",) + FASTQ))
    v = g.valid_groups().orderBy("row_number").collect()
    assert len(v) == 24
    assert [r["row_number"] for r in v] == list(range(24))
    # first appearance in name order: sample10 sorts before sample2
    assert v[0]["row_key"] == "sample10_S10_L001_001_fastq_gz"
    assert g.invalid_files().count() == 0


def test_minimal_pair_and_lane_as_column(spark):
    pair = NameGrouping(listing(spark, "/p", ["r1_c1.txt", "r1_c2.txt"]),
                        rules(spark, ("/p", "1", ["_", ".txt"], ["H1", "H2"], [0], [1], 0, 1000)))
    (row,) = pair.valid_groups().collect()
    assert row["cells"] == {"c1": "r1_c1.txt", "c2": "r1_c2.txt"}
    lanes = NameGrouping(
        listing(spark, "/l", ["sample1_S1_L001_R1_001.fastq.gz", "sample1_S1_L002_R1_001.fastq.gz",
                              "sample2_S2_L001_R1_001.fastq.gz"]),
        rules(spark, ("/l", "1", ["_", ".fastq.gz"], ["a", "b"], [0, 1], [2], 0, 0)))
    assert lanes.valid_groups().count() == 1
    assert lanes.invalid_files().count() == 1


def test_collision_last_wins(spark):
    # two names give the same row and column key: the later one (name order) wins
    g = NameGrouping(listing(spark, "/c", ["a_x_1.txt", "a_x_2.txt", "a_y_1.txt"]),
                     rules(spark, ("/c", "1", ["_", "."], ["x", "y"], [0], [1], 0, 0)))
    (row,) = g.valid_groups().collect()
    assert row["cells"] == {"x": "a_x_2.txt", "y": "a_y_1.txt"}
    assert [(r["name"], r["winner"]) for r in g.collisions().collect()] == [("a_x_1.txt", "a_x_2.txt")]


def test_empty_rule_gives_one_invalid_row(spark):
    g = NameGrouping(listing(spark, "/e", ["a.txt", "b.txt", "c.txt"]),
                     rules(spark, ("/e", "", [], [], [], [], 0, 0)))
    assert g.rows.count() == 1
    assert g.valid_groups().count() == 0
    assert [r["name"] for r in g.invalid_files().collect()] == ["c.txt"]


def test_nearest_rule_and_rejects(spark):
    lst = (listing(spark, "/r/a", ["x_1.txt", "x_2.txt"])
           .unionByName(listing(spark, "/r/a/b", ["y_1.txt"]))
           .unionByName(listing(spark, "/q", ["z_1.txt"]))
           .unionByName(listing(spark, "/r/bad", ["w_1.txt"])))
    rs = rules(spark, ("/r", "1", ["_", "."], ["1", "2"], [0], [1], 0, 0),
               ("/r/a/b", "2", ["_", "."], ["only"], [1], [0], 0, 0),
               ("/r/bad", "3", ["_"], ["h"], [0, 1], [1], 0, 0))
    b = build_blocks(lst, rs)
    heads = {r["block_id"]: (r["rule_version"], r["n_rows"]) for r in b.block_heads.collect()}
    assert heads == {"/r/a": ("1", 1), "/r/a/b": ("2", 1)}
    assert {(r["folder_path"], r["reason"]) for r in b.rejects.collect()} == {
        ("/q", "missing rule"), ("/r/bad", "invalid rule")}


def test_blocks_alone_write_and_number_valid_rows_only(spark):
    """Heads are numbered without cells, and once with them if the rows were read before."""
    names = [f"sample{s}_S{s}_L001_R{r}_001.fastq.gz" for s in range(1, 30) for r in (1, 2) if (s, r) != (7, 2)] + ["odd.txt"]
    lst = listing(spark, "/d", names).unionByName(listing(spark, "/e", ["one.txt", "two.txt"]))
    rs = rules(spark, ("/d",) + FASTQ, ("/e", "", [], [], [], [], 0, 0))
    whole, blocks = build_blocks(lst, rs), build_blocks(lst, rs, valid_only=True)
    heads = sorted(map(str, whole.block_heads.collect()))
    assert sorted(map(str, blocks.block_heads.collect())) == heads and "n_rows=28" in heads[0] and "n_rows=0" in heads[1]
    assert "numbered_valid" not in blocks.grouping.__dict__
    assert set(blocks.grouping.entries.columns) == {"folder_path", "first_seen", "entries"}
    assert blocks.grouping.entries.count() == 28
    assert sorted(map(str, blocks.block_rows.collect())) == sorted(map(str, whole.block_rows.collect()))
    assert "row_number" in blocks.grouping.numbered_heads.columns
    again = build_blocks(lst, rs, valid_only=True)
    assert again.block_rows.count() == 28
    assert sorted(map(str, again.block_heads.collect())) == heads
    for output in ("rows", "cells", "valid_rows"):
        with pytest.raises(ValueError):
            getattr(blocks.grouping, output)


def test_cells_of_listed_order_and_repeated_files(spark):
    """The last file of a cell in listing order wins, whatever its name; repeated files count."""
    rows = [("/l", n, i) for i, n in enumerate(["a_x_9.t", "a_x_1.t", "b_y_1.t", "a_z_1.t", "a_x_5.t", "a_z_1.t"])]
    rule = rules(spark, ("/l", "1", ["_", "."], ["x", "z"], [0], [1], 0, 0))
    def cells(g):
        return sorted((r["row_key"], r["col_key"], r["name"], r["n_names"], r["n_cols"], r["first_seen"]) for r in g.cells.collect())
    listed = spark.createDataFrame(rows, "folder_path string, name string, ord long")
    assert cells(NameGrouping(listed, rule)) == [("a", "x", "a_x_5.t", 3, 2, 0), ("a", "z", "a_z_1.t", 2, 2, 0), ("b", "y", "b_y_1.t", 1, 1, 2)]
    assert cells(NameGrouping(listed.drop("ord"), rule)) == [
        ("a", "x", "a_x_9.t", 3, 2, "a_x_1.t"), ("a", "z", "a_z_1.t", 2, 2, "a_x_1.t"), ("b", "y", "b_y_1.t", 1, 1, "b_y_1.t")]


def test_ranged_index_equals_window(spark):
    rows = [("hot", f"k{i:05d}") for i in range(3000)] + [(f"f{i % 7}", f"k{i:05d}") for i in range(500)]
    df = spark.createDataFrame(rows, "folder_path string, first_seen string")
    a = {(r[0], r[1], r[2]) for r in ranged_index(df, ["folder_path"], ["first_seen"], "i", num_partitions=16).collect()}
    b = {(r[0], r[1], r[2]) for r in window_index(df, ["folder_path"], ["first_seen"], "i").collect()}
    assert a == b
    g = ranged_index(df, [], ["folder_path", "first_seen"], "i", base=1, num_partitions=5)
    assert sorted(r["i"] for r in g.collect()) == list(range(1, 3501))


def test_forced_ranged_numbering_in_grouping(spark):
    names = [f"sample{s}_S{s}_L001_R{r}_001.fastq.gz" for s in range(1, 60) for r in (1, 2)]
    lst = listing(spark, "/d", names)
    rs = rules(spark, ("/d",) + FASTQ)
    a = valid_set(NameGrouping(lst, rs))
    b = valid_set(NameGrouping(lst, rs, reuse=False))
    assert a == b and len(a) == 59


# ---- property test: pure-Python model of split -> keys -> group -> filter -> number

def model(names, delims, row_parts, col_parts, n_header):
    def split(n):
        for d in delims:
            n = n.replace(d, " ") if d else n
        return n.split()

    def key(parts, idx):
        return "_".join(parts[i] for i in idx if 0 <= i < len(parts))

    rows, first = {}, {}
    for n in sorted(names):
        p = split(n)
        rk, ck = key(p, row_parts), key(p, col_parts)
        first.setdefault(rk, n)
        rows.setdefault(rk, {})[ck] = n
    valid = [rk for rk in sorted(rows, key=lambda r: first[r]) if len(rows[rk]) == n_header]
    return {(i, tuple(sorted(rows[rk].items()))) for i, rk in enumerate(valid)}


name_chars = st.sampled_from(list("ab_.-1") + [" ", "　"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names=st.sets(st.text(name_chars, min_size=0, max_size=8), min_size=1, max_size=25),
       row_parts=st.lists(st.integers(0, 3), max_size=3, unique=True),
       col_parts=st.lists(st.integers(0, 3), max_size=2, unique=True),
       n_header=st.integers(1, 3))
def test_grouping_matches_model(spark, names, row_parts, col_parts, n_header):
    delims = ["_", "."]
    header = [string.ascii_uppercase[i] for i in range(n_header)]
    rs = rules(spark, ("/m", "1", delims, header, row_parts, col_parts, 0, 0))
    got = {(r[1], r[2]) for r in valid_set(NameGrouping(listing(spark, "/m", sorted(names)), rs))}
    assert got == model(names, delims, row_parts, col_parts, n_header)


def model_in_order(names, delims, row_parts, col_parts, n_header):
    """As ``model`` but the list order (not name order) is the listing order."""
    def split(n):
        for d in delims:
            n = n.replace(d, " ") if d else n
        return n.split()

    def key(parts, idx):
        return "_".join(parts[i] for i in idx if 0 <= i < len(parts))

    rows, first = {}, {}
    for pos, n in enumerate(names):
        p = split(n)
        rk, ck = key(p, row_parts), key(p, col_parts)
        first.setdefault(rk, pos)
        rows.setdefault(rk, {})[ck] = n
    valid = [rk for rk in sorted(rows, key=lambda r: first[r]) if len(rows[rk]) == n_header]
    return {(i, tuple(sorted(rows[rk].items()))) for i, rk in enumerate(valid)}


def test_listed_names_use_list_order(spark):
    from tessera.sources.listing import listed_names
    # a_A.txt2 comes before a_A.txt in the list: the later one in the list
    # wins the cell although it sorts first by name
    names = ["z_B.txt", "a_A.txt2", "z_A.txt", "a_B.txt", "a_A.txt"]
    lists = spark.createDataFrame([("/o", names)], "folder_path string, names array<string>")
    exploded = listed_names(lists)
    assert [r["ord"] for r in exploded.orderBy("ord").collect()] == list(range(len(names)))
    g = NameGrouping(exploded, rules(spark, ("/o", "1", ["_", "."], ["A", "B"], [0], [1], 0, 0)))
    got = {(r["row_number"], tuple(sorted(r["cells"].items()))) for r in g.valid_groups().collect()}
    want = model_in_order(names, ["_", "."], [0], [1], 2)
    assert got == want
    assert got == {(0, (("A", "z_A.txt"), ("B", "z_B.txt"))),
                   (1, (("A", "a_A.txt"), ("B", "a_B.txt")))}


def test_crowded_rows_match_the_plain_grouping(spark):
    """Rows of more files than are shuffled by row: one cell of many names, a row
    of many columns, a valid row as wide as its header, beside small rows."""
    wide = [f"c{i:03d}" for i in range(150)]
    lst = (listing(spark, "/one", [f"a_x_{i}.txt" for i in range(300)] + ["a_y_0.txt", "b_x_0.txt"])
           .unionByName(listing(spark, "/cols", [f"a_{c}.txt" for c in wide] + ["b_x.txt", "b_y.txt"]))
           .unionByName(listing(spark, "/wide", [f"a_{c}.txt" for c in wide] + ["b_c001.txt"])))
    g = NameGrouping(lst, rules(spark, ("/one", "1", ["_", "."], ["x", "y"], [0], [1], 0, 0), ("/cols", "1", ["_", "."], ["x", "y"], [0], [1], 0, 0),
                                ("/wide", "1", ["_", "."], wide, [0], [1], 0, 0)))
    got = {(r["folder_path"], r["row_number"], r["row_key"], r["first_seen"]): r["cells"] for r in g.valid_groups().collect()}
    assert got == {("/one", 0, "a", "a_x_0.txt"): {"x": "a_x_99.txt", "y": "a_y_0.txt"},
                   ("/cols", 0, "b", "b_x.txt"): {"x": "b_x.txt", "y": "b_y.txt"},
                   ("/wide", 0, "a", "a_c000.txt"): {c: f"a_{c}.txt" for c in wide}}
    assert {(r["folder_path"], r["row_key"], r["n_cols"]) for r in g.rows.collect()} == {
        ("/one", "a", 2), ("/one", "b", 1), ("/cols", "a", 150), ("/cols", "b", 2), ("/wide", "a", 150), ("/wide", "b", 1)}
    assert g.cells.count() == 2 + 1 + 150 + 2 + 150 + 1
    assert sorted(r["name"] for r in g.invalid_files().collect()) == sorted([f"a_{c}.txt" for c in wide] + ["b_x_0.txt", "b_c001.txt"])
    assert g.collisions().count() == 299


def test_valid_rows_are_not_joined_with_their_cells(spark):
    names = [f"sample{s}_S{s}_L001_R{r}_001.fastq.gz" for s in range(1, 60) for r in (1, 2)]
    g = NameGrouping(listing(spark, "/d", names), rules(spark, ("/d",) + FASTQ))
    text = g.valid_groups()._jdf.queryExecution().executedPlan().toString()
    # the one join is that of the numbering's offsets, which are written
    assert text.count("Join") == 1 and "Window" not in text


def test_rows_are_written_once_each(spark):
    """One written row per row key, with its cells; blocks number only what they show."""
    names = [f"sample{s}_S{s}_L001_R{r}_001.fastq.gz" for s in range(1, 60) for r in (1, 2)] + ["sample60_S60_L001_R1_001.fastq.gz"]
    g = NameGrouping(listing(spark, "/d", names), rules(spark, ("/d",) + FASTQ))
    written = spark.read.parquet(*g.cells.inputFiles())
    assert written.count() == g.rows.count() == 60 and g.cells.count() == 119
    assert "row_key" not in g.numbered_valid._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_collisions_stay_with_their_cells(spark):
    g = NameGrouping(listing(spark, "/c", ["a_x_1.txt", "a_x_2.txt", "a_y_1.txt", "b_x_1.txt", "b_y_1.txt", "b_y_2.txt", "b_y_2.txt"]),
                     rules(spark, ("/c", "1", ["_", "."], ["x", "y"], [0], [1], 0, 0)))
    assert {(r["row_key"], r["col_key"], r["name"], r["n_names"], r["n_cols"]) for r in g.cells.collect()} == {
        ("a", "x", "a_x_2.txt", 2, 2), ("a", "y", "a_y_1.txt", 1, 2), ("b", "x", "b_x_1.txt", 1, 2), ("b", "y", "b_y_2.txt", 3, 2)}
    assert [r["entries"] for r in g.valid_rows.orderBy("row_key").collect()] == [[("x", "a_x_2.txt"), ("y", "a_y_1.txt")], [("x", "b_x_1.txt"), ("y", "b_y_2.txt")]]
