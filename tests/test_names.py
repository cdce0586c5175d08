"""Name functions: split, keys, exclusions, globs, CSV quoting."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions.names import (base_name, csv_field, file_excluded, format_time, glob_match, glob_to_regex,
                                     parts_key, parts_key_upto, prefixes_at, split_name,
                                     split_name_upto, DEFAULT_FILE_EXCLUSIONS)

FASTQ_DELIMS = ["_", "."]


def _one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} {t}" for n, t in
                                                                          [(n, _t(cols[n])) for n in names]))
    return df.select(expr.alias("r")).first()["r"]


def _t(v):
    if isinstance(v, list):
        return "array<int>" if v and isinstance(v[0], int) else "array<string>"
    return "string"


@pytest.mark.parametrize("name,delims,want", [
    ("sample1_S1_L001_R1_001.fastq.gz", ["_", ".fastq.gz"], ["sample1", "S1", "L001", "R1", "001"]),
    ("sample1_S1_L001_R1_001.fastq.gz", FASTQ_DELIMS, ["sample1", "S1", "L001", "R1", "001", "fastq", "gz"]),
    ("__sample5..S5_ L001 R1__001.fastq.gz", FASTQ_DELIMS, ["sample5", "S5", "L001", "R1", "001", "fastq", "gz"]),
    ("", FASTQ_DELIMS, []),
    ("___", FASTQ_DELIMS, []),
    ("a b　c d", [], ["a", "b", "c", "d"]),
    ("r1_c1.txt", ["_", ".txt"], ["r1", "c1"]),
    ("no-delims", ["", "_"], ["no-delims"]),
])
def test_split_matches_both_forms(spark, name, delims, want):
    got_hof = _one(spark, split_name("n", "d"), n=name, d=delims)
    got_unrolled = _one(spark, split_name_upto("n", "d", 3), n=name, d=delims)
    assert got_hof == want
    assert got_unrolled == want


def test_delimiters_apply_in_order(spark):
    # "_b" first turns "a_b" into "a " -> one part; the other order would differ
    assert _one(spark, split_name_upto("n", "d", 2), n="a_b", d=["_b", "a_"]) == ["a"]


@pytest.mark.parametrize("parts,idx,want", [
    (["sample1", "S1", "L001", "R1", "001", "fastq", "gz"], [0, 1, 2, 4, 5, 6], "sample1_S1_L001_001_fastq_gz"),
    (["sample13", "S13", "L001", "R1", "fastq", "gz"], [0, 1, 2, 4, 5, 6], "sample13_S13_L001_fastq_gz"),
    (["sample16", "S16", "L001", "fastq", "gz"], [3], "fastq"),
    (["a"], [5, 7], ""),
    (["a", "b"], [-1, 1], "b"),
    (["a", "b"], [], ""),
])
def test_parts_key(spark, parts, idx, want):
    assert _one(spark, parts_key("p", "i"), p=parts, i=idx) == want
    assert _one(spark, parts_key_upto("p", "i", 6), p=parts, i=idx) == want


def test_default_exclusions(spark):
    names = ["a.json", "a.csv.gz", "invalid_files", "invalid_files_1.txt", "k.txt", "x.pb", "file2.log"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    kept = {r[0] for r in df.where(~file_excluded("name", DEFAULT_FILE_EXCLUSIONS)).collect()}
    assert kept == {"invalid_files_1.txt", "k.txt", "file2.log"}


def test_glob_translation():
    rx = re.compile(glob_to_regex("*_R1_*.fastq.gz"))
    assert rx.match("sample1_S1_L001_R1_001.fastq.gz")
    assert not rx.match("sample1_S1_L001_R2_001.fastq.gz")
    assert not rx.match("dir/x_R1_y.fastq.gz")
    assert re.match(glob_to_regex("file?.[tl]x?"), "file1.txt")
    assert not re.match(glob_to_regex("[^a]*"), "abc")


@pytest.mark.parametrize("v,want", [
    ("plain.txt", "plain.txt"), ("", ""), ("a,b", '"a,b"'), ('say "hi"', '"say ""hi"""'),
    (" lead", '" lead"'), ("\\.", '"\\."'), ("x\ny", '"x\ny"'),
])
def test_csv_field(spark, v, want):
    assert _one(spark, csv_field("v"), v=v) == want


def test_paths(spark):
    assert _one(spark, base_name("p"), p="/data/run_01/") == "run_01"
    assert _one(spark, prefixes_at("p", [2, 3, 4]), p="/data/run_01") == ["/data", "/data/run_01"]
    assert _one(spark, F.concat(base_name("p"), F.lit("files.pb")), p="/corpus/src1/en") == "enfiles.pb"


def test_time_formats(spark):
    import datetime as dt
    from tessera.sinks.files import invalid_files_name
    df = spark.createDataFrame([(dt.datetime(2024, 3, 5, 7, 8, 9),)], "ts timestamp_ntz")
    assert df.select(format_time("ts")).first()[0] == "2024-03-05 07:08:09"
    assert invalid_files_name(dt.datetime(2024, 3, 5, 7, 8, 9)) == "invalid_files_20240305070809"


def test_glob_classes(spark):
    cases = [("a[\\]]b", "a]b", True), ("a[[]b", "a[b", True), ("a[b&&c]d", "a&d", True), ("a[b&&c]d", "acd", True), ("a[a-c]z", "abz", True),
             ("a[^a-c]z", "abz", False), ("a[^a-c]z", "adz", True), ("[.]x", ".x", True), ("[.]x", "ax", False), ("a[\\-x]b", "a-b", True), ("[c-a]", "b", False)]
    for pattern, name, want in cases:
        df = spark.createDataFrame([(name,)], "name string")
        assert df.select(glob_match("name", pattern)).first()[0] is want, (pattern, name)
    for bad in ("[", "[]a]", "[a", "[-a]", "[a-]"):
        with pytest.raises(ValueError, match="bad glob"):
            glob_to_regex(bad)
