"""Rule-driven grouping of file names into rows and cells.

Pipeline (all folders in one job, each folder with its own rule):

    keyed   : one row per file  (folder_path, name, row_key, col_key, expected)
    cells   : one row per (folder, row_key, col_key); the later file in
              listing order wins the cell, earlier ones are collisions
    rows    : one row per (folder, row_key): number of distinct column keys,
              the first file seen and its cells; this is what is written
    valid   : rows whose column count equals the header size, numbered from
              0 per folder in order of first appearance

The keys are written once. Files whose row has few files (at most ``CROWDED``)
are shuffled once, by row: their cells, the row's column count and first file
and its collected cells come from that one sorted pass, which writes a row for
each row key. Files of crowded rows
(an empty rule puts a whole folder in one row) are aggregated with plain
``groupBy`` instead, whose map-side partial aggregation collapses a hot key
before the shuffle; of these, cells are collected only for valid rows, whose
width is bounded by the header size. Invalid rows stay long.

Least and greatest names are texts, which Spark aggregates over sorted rows. So
a hash of the keys leads the keys: it decides nearly all comparisons of the
sort, which long equal paths would make costly.

Listing order is name order (a directory listing is sorted by name) unless
the listing carries an explicit ``ord`` column (names given as a list).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import parts_key_upto, split_name_upto
from ..sources.rules import RulePlan, plan_rules
from ..session import materialize
from .indexing import ranged_index

ROW = ["folder_path", "row_key", "expected"]
CELL = ["folder_path", "row_key", "col_key", "expected"]
CROWDED = 100  # files of a row above which it is aggregated before it is shuffled


def _order_col(df: DataFrame) -> str:
    return "ord" if "ord" in df.columns else "name"


def name_parts(listing_with_rules: DataFrame, plan: RulePlan) -> DataFrame:
    """Add ``parts`` (array) to a listing that carries rule columns."""
    return listing_with_rules.withColumn(
        "parts", split_name_upto("name", "delimiter", plan.max_delimiters))


def name_keys(listing_with_rules: DataFrame, plan: RulePlan) -> DataFrame:
    """(folder_path, name[, ord], row_key, col_key, expected)."""
    extra = ["ord"] if "ord" in listing_with_rules.columns else []
    p = name_parts(listing_with_rules, plan)
    return p.select(
        "folder_path", "name", *extra,
        parts_key_upto("parts", "row_parts", plan.max_indexes).alias("row_key"),
        parts_key_upto("parts", "col_parts", plan.max_indexes).alias("col_key"),
        F.size(F.coalesce("header", F.array().cast("array<string>"))).alias("expected"),
    )


class NameGrouping:
    """All grouping outputs of one listing under its folder rules.

    ``listing`` is ``(folder_path, name[, size][, ord])``; ``rules`` is a
    rules DataFrame (see ``sources.rules``). Folders without a rule are
    skipped here (``plans.build`` reports them). With ``valid_only`` just what numbered
    blocks show is written of the rows: valid ones' folder, first file and entries;
    other outputs can't be read then.
    """

    def __init__(self, listing: DataFrame, rules: DataFrame | None = None, *,
                 keyed: DataFrame | None = None, reuse: bool = True, keep_keyed: bool = False,
                 valid_only: bool = False):
        if keyed is None:
            cols = ["folder_path", "name"] + (["ord"] if "ord" in listing.columns else [])
            plan = rules if isinstance(rules, RulePlan) else plan_rules(rules)
            keyed = name_keys(plan.attach(listing.select(*cols)), plan)
        hashed = keyed.select(F.xxhash64(*ROW).alias("_row"), "*")
        # the per-file keys are read for the hot rows, the cells and the collisions
        self.hashed = materialize(hashed, "keyed") if reuse or keep_keyed else hashed
        self.keyed = self.hashed.drop("_row")
        self.order = _order_col(keyed)
        self.reuse = reuse
        self.valid_only = valid_only

    def _collapsed(self, keyed: DataFrame, *keys) -> DataFrame:
        o = self.order
        winner = F.max("name") if o == "name" else F.max_by("name", o)
        return keyed.groupBy(*keys).agg(winner.alias("name"), F.min(o).alias("first_ord"), F.count(F.lit(1)).alias("n_names"))

    def _few(self, keyed: DataFrame) -> DataFrame:
        """Rows of at most ``CROWDED`` files with their cells, by one shuffle."""
        cells = self._collapsed(keyed.repartition("_row", *ROW), "_row", *ROW, "col_key")
        w = Window.partitionBy("_row", *ROW).orderBy("col_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = cells.select(*ROW, F.count(F.lit(1)).over(w).alias("n_cols"), F.min("first_ord").over(w).alias("first_seen"),
                            F.collect_list(F.struct("col_key", "name", "n_names")).over(w).alias("own"),
                            (F.col("col_key") == F.first("col_key").over(w)).alias("_stands"))
        return rows.where("_stands").drop("_stands")

    def _many(self, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The same of rows of any size: no row's files or cells meet in one task
        before they are aggregated, and only valid rows' cells are collected. Also
        the cells of the others, long."""
        cells = materialize(self._collapsed(keyed, F.xxhash64(*CELL).alias("_hash"), *CELL).drop("_hash"), "crowded-cells")
        rows = materialize(cells.groupBy(F.xxhash64(*ROW).alias("_hash"), *ROW).agg(
            F.count(F.lit(1)).alias("n_cols"), F.min("first_ord").alias("first_seen")).drop("_hash"), "crowded-rows")
        valid = rows.where(F.col("n_cols") == F.col("expected"))
        own = F.array_sort(F.collect_list(F.struct("col_key", "name", "n_names")))
        own = cells.join(valid.select(*ROW), ROW, "left_semi").groupBy(*ROW).agg(own.alias("own"))
        other = rows.where(F.col("n_cols") != F.col("expected")).select(*ROW, "n_cols", "first_seen")
        return rows.join(own, ROW, "left"), cells.drop("first_ord").join(other, ROW).select(*CELL, "name", "n_names", "n_cols", "first_seen")

    def _by_row(self) -> tuple[DataFrame, DataFrame | None]:
        """One row per row key: ``n_cols``, ``first_seen`` (earliest file) and ``own`` (its cells
        by column key); and the cells of crowded invalid rows, whose ``own`` is null."""
        crowded = self.hashed.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED)
        crowded = materialize(crowded.select("_row"), "crowded")
        if crowded.isEmpty():
            rows, long = self._few(self.hashed), None
        else:
            many, long = self._many(self.hashed.join(crowded, "_row", "left_semi"))
            rows = self._few(self.hashed.join(crowded, "_row", "left_anti")).unionByName(many)
        return rows, long

    @cached_property
    def _grouped(self) -> tuple[DataFrame, DataFrame | None]:
        if self.valid_only:
            raise ValueError("only the valid rows of this grouping are kept")
        rows, long = self._by_row()
        # rows, valid, invalid and the CSV all read the rows: write them
        # once (a parquet table in the checkpoint folder)
        return (materialize(rows, "rows") if self.reuse else rows), long

    @cached_property
    def cells(self) -> DataFrame:
        """One row per cell: winner ``name`` (the last file of the cell in listing
        order), ``n_names`` and its row's ``n_cols`` and ``first_seen`` (earliest file)."""
        rows, long = self._grouped
        own = rows.select(*ROW, "n_cols", "first_seen", F.inline("own")).select(*CELL, "name", "n_names", "n_cols", "first_seen")
        return own if long is None else own.unionByName(long)

    @cached_property
    def rows(self) -> DataFrame:
        """One row per row key: ``n_cols`` and ``first_seen``."""
        return self._grouped[0].select(*ROW, "n_cols", "first_seen")

    def number(self, rows: DataFrame, out: str) -> DataFrame:
        """0-based position per folder by first appearance."""
        return ranged_index(rows, ["folder_path"], ["first_seen"], out=out)

    def numbered_rows(self) -> DataFrame:
        """Every row with ``row_index`` by first appearance (0-based)."""
        return self.number(self.rows, "row_index")

    @cached_property
    def valid_rows(self) -> DataFrame:
        """Rows whose column count equals the header size, with their cells as
        sorted ``entries``."""
        return self._valid(self._grouped[0])

    @staticmethod
    def _valid(rows: DataFrame) -> DataFrame:
        entries = F.arrays_zip(F.col("own.col_key").alias("col_key"), F.col("own.name").alias("name"))
        return rows.where(F.col("n_cols") == F.col("expected")).select(*ROW, "n_cols", "first_seen", entries.alias("entries"))

    @cached_property
    def entries(self) -> DataFrame:
        """What numbered blocks show of valid rows: (folder_path, first_seen, entries)."""
        rows = self._valid(self._by_row()[0]) if self.valid_only else self.valid_rows
        rows = rows.select("folder_path", "first_seen", "entries")
        return materialize(rows, "valid") if self.valid_only and self.reuse else rows

    @cached_property
    def folders(self) -> DataFrame:
        """(folder_path) of all rows, valid or not."""
        return (self.keyed if self.valid_only else self.rows).select("folder_path").distinct()

    @cached_property
    def valid_cells(self) -> DataFrame:
        return self.cells.where(F.col("n_cols") == F.col("expected")).select(*CELL, "name")

    @cached_property
    def invalid_cells(self) -> DataFrame:
        """Cells of rows whose column count differs from the header size."""
        return self.cells.where(F.col("n_cols") != F.col("expected"))

    @cached_property
    def numbered_valid(self) -> DataFrame:
        """Valid rows' cells with their ``row_number``, without what only ``valid_groups``
        shows of them: (folder_path, row_number, entries)."""
        return self.number(self.entries, "row_number").select("folder_path", "row_number", "entries")

    @cached_property
    def numbered_heads(self) -> DataFrame:
        """(folder_path, row_number) of valid rows: those of ``numbered_valid`` where they
        are numbered already, or else numbered without their cells."""
        if "numbered_valid" in self.__dict__:
            return self.numbered_valid.select("folder_path", "row_number")
        return self.number(self.entries.drop("entries"), "row_number").select("folder_path", "row_number")

    def valid_groups(self) -> DataFrame:
        """Valid rows numbered 0.. per folder by first appearance, with their
        cells as a map (at most ``expected`` entries per row)."""
        return self.number(self.valid_rows, "row_number").select(
            "folder_path", "row_number", "row_key", "first_seen", "n_cols", "expected", F.map_from_entries("entries").alias("cells"), "entries")

    def invalid_files(self) -> DataFrame:
        """Names kept in invalid rows (cell winners), long form."""
        return self.invalid_cells.select("folder_path", "row_key", "col_key", "name")

    def collisions(self) -> DataFrame:
        """Files that lost their cell to a later file with the same keys."""
        hot = (self.cells.where(F.col("n_names") > 1)
               .select(*CELL, F.col("name").alias("winner")))
        return (self.keyed.join(hot, CELL)
                .where(F.col("name") != F.col("winner"))
                .select("folder_path", "row_key", "col_key", "name", "winner"))

    def column_keys(self) -> DataFrame:
        """Distinct column keys of valid rows per folder with their sorted
        position (the CSV column order)."""
        keys = self.valid_cells.select("folder_path", "col_key").distinct()
        return ranged_index(keys, ["folder_path"], ["col_key"], out="key_pos")
