"""Registered queries against their DuckDB oracle SQL on sf0.001
(the full set runs at sf0.01 with tools/check_oracle.py)."""

import datetime as dt
import math

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from tessera.sources.tables import TABLE_NAMES

from conftest import SF_SMALL

SUBSET = ["valid_groups", "invalid_files", "cell_collisions", "group_files", "column_keys",
          "csv_layout", "file_changes", "folder_diff", "apply_file_changes", "rule_conflicts",
          "split_names", "glob_search", "generate_rows", "version_gate", "incremental_blocks",
          "diff_all", "folder_totals_incremental", "folder_files", "header_mismatch", "scan_with_times", "folder_names"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(oracle_sql()[name])
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    assert sorted(df.columns) == sorted(o_cols)
    assert _rows(df.columns, s_rows) == _rows(o_cols, o_rows)
