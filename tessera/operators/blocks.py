"""Blocks: the published form of valid rows.

A block is one folder's table: ``block_id`` (the folder path), the rule's
column headers and its valid rows. The primary storage is long and flat so
no block has to fit in one row:

* ``block_heads``: block_id, column_headers, n_rows, rule_version
* ``block_rows`` : block_id, row_number, cells (map col_key -> file name)

No form holds a whole block in one row: the text dump (``sinks.files``) has
a line per block head and a line per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indexing import ranged_index

def long_cells(block_rows: DataFrame) -> DataFrame:
    """(block_id, row_number, col_key, name): one row per cell."""
    cells = F.inline("entries") if "entries" in block_rows.columns else F.explode("cells").alias("col_key", "name")
    return block_rows.select("block_id", "row_number", cells)


def override_headers(block_heads: DataFrame, headers: list[str]) -> DataFrame:
    """Replace every block's column headers with the caller's."""
    return block_heads.withColumn("column_headers",
                                  F.array(*[F.lit(h) for h in headers]).cast("array<string>"))


def merge_blocks(sets: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One block set from several published ones, given as (heads, rows): all
    blocks of all sets. A block that several sets hold is taken from the last
    of them."""
    def numbered(i: int, df: DataFrame) -> DataFrame:
        return df.withColumn("_set", F.lit(i))

    heads = reduce(DataFrame.unionByName, [numbered(i, h) for i, (h, _) in enumerate(sets)])
    rows = reduce(DataFrame.unionByName, [numbered(i, r) for i, (_, r) in enumerate(sets)])
    last = heads.groupBy("block_id").agg(F.max("_set").alias("_set"))
    return heads.join(last, ["block_id", "_set"]).drop("_set"), rows.join(last, ["block_id", "_set"], "left_semi").drop("_set")


def datablock(block_heads: DataFrame, updated_at) -> DataFrame:
    """The block set stamped with one publish time (UTC wall clock, taken
    once by the caller, so every block of a version carries the same
    stamp). Raises on an empty block set."""
    if block_heads.limit(1).count() == 0:
        raise ValueError("an empty block set cannot be published")
    return block_heads.withColumn("updated_at", F.lit(str(updated_at)).cast("timestamp_ntz"))


def generate_rows(data: DataFrame, cells: str, order_by: list[str],
                  headers: list[str]) -> DataFrame:
    """Rows from positional cell arrays: row_number is 1-based in
    ``order_by`` order; header j maps to cell j; surplus headers or cells
    are dropped."""
    numbered = ranged_index(data.select(*order_by, cells), [], order_by, out="row_number", base=1)
    h = F.array(*[F.lit(x) for x in headers]).cast("array<string>")
    k = F.least(F.size(h), F.size(cells))
    return numbered.select("row_number", *order_by,
                           F.map_from_arrays(F.slice(h, 1, k), F.slice(cells, 1, k)).alias("cells"))
