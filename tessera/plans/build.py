"""Block build for all folders of a listing in one job.

Per folder: nearest rule -> rule check -> split names -> row / column keys
-> group -> valid / invalid -> number rows -> block. Folders without a rule
or with a broken rule go to ``rejects`` instead of failing the whole build
(``strict=True`` raises on them).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import base_name
from ..operators.grouping import NameGrouping, name_keys
from ..session import materialize
from ..sources.rules import RulePlan, folder_rules, plan_rules


@dataclass
class BlockBuild:
    listing: DataFrame
    rules: DataFrame
    folders: DataFrame | None = None  # (folder_path) of the listing, where they are known
    valid_only: bool = False  # only blocks and rejects are read, not the grouping's other outputs

    @cached_property
    def plan(self) -> RulePlan:
        return self.rules if isinstance(self.rules, RulePlan) else plan_rules(self.rules)

    @cached_property
    def folder_rules(self) -> DataFrame:
        folders = self.listing.select("folder_path").distinct()
        return folders.join(folder_rules(folders, self.plan), "folder_path", "left")

    @cached_property
    def rejects(self) -> DataFrame:
        """(folder_path, reason) for folders that get no block."""
        fr = self.folder_rules
        reason = (F.when(F.col("folder_prefix").isNull(), F.lit("missing rule"))
                  .when(~F.col("rule_ok"), F.lit("invalid rule")))
        return fr.select("folder_path", reason.alias("reason")).where(F.col("reason").isNotNull())

    @cached_property
    def grouping(self) -> NameGrouping:
        cols = ["folder_path", "name"] + (["ord"] if "ord" in self.listing.columns else [])
        attached = self.plan.attach(self.listing.select(*cols), self.folders).where(F.col("rule_ok"))
        return NameGrouping(None, keyed=name_keys(attached, self.plan), valid_only=self.valid_only)

    @cached_property
    def valid(self) -> DataFrame:
        """Valid rows: (folder_path, row_number, cells, entries)."""
        return self.grouping.numbered_valid.select("folder_path", "row_number", F.map_from_entries("entries").alias("cells"), "entries")

    @cached_property
    def block_rows(self) -> DataFrame:
        return self.valid.select(F.col("folder_path").alias("block_id"), "row_number",
                                 "cells", "entries")

    @cached_property
    def block_heads(self) -> DataFrame:
        """One head per folder with a valid rule (such a folder has at least
        one file, so its folders are read from what the grouping wrote). Rows are
        numbered with their cells only where ``valid`` was read before."""
        g = self.grouping
        counts = g.numbered_heads.groupBy("folder_path").agg(F.count(F.lit(1)).alias("n_rows"))
        return (folder_rules(g.folders, self.plan).join(counts, "folder_path", "left")
                .select(F.col("folder_path").alias("block_id"),
                        F.coalesce("header", F.array().cast("array<string>")).alias("column_headers"),
                        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
                        F.col("version").alias("rule_version"), "rule_hash",
                        F.concat(base_name("folder_path"), F.lit("files.pb")).alias("block_file")))

    def check_strict(self) -> None:
        bad = self.rejects.limit(1).collect()
        if bad:
            raise ValueError(f"folder {bad[0]['folder_path']!r}: {bad[0]['reason']}")


def build_blocks(listing: DataFrame, rules: DataFrame, strict: bool = False, folders: DataFrame | None = None,
                 valid_only: bool = False) -> BlockBuild:
    b = BlockBuild(listing, rules, folders, valid_only)
    if strict:
        b.check_strict()
    return b


def incremental_blocks(old_heads: DataFrame, old_rows: DataFrame, listing: DataFrame,
                       rules: DataFrame, changed_folders: DataFrame,
                       existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Reuse the blocks of folders that did not change (same files, same
    rule in every field), rebuild the rest from the listing. Blocks of folders
    no longer in the listing are dropped; with ``existing`` (folder_path: the
    folders that exist, with or without files) only those of folders that exist
    are, and a vanished folder keeps its block. Returns (heads, rows)."""
    plan = rules if isinstance(rules, RulePlan) else plan_rules(rules)
    live = listing.select("folder_path").distinct()
    live_rules = folder_rules(live, plan).select(F.col("folder_path").alias("block_id"), "rule_hash")
    reuse = (old_heads.join(live_rules, ["block_id", "rule_hash"], "left_semi")
             .join(changed_folders.select(F.col("folder_path").alias("block_id")), "block_id", "left_anti"))
    if existing is not None:
        reuse = reuse.unionByName(old_heads.join(existing.select(F.col("folder_path").alias("block_id")), "block_id", "left_anti"))
    reuse = materialize(reuse, "reused-heads")
    rebuild_listing = listing.join(reuse.select(F.col("block_id").alias("folder_path")),
                                   "folder_path", "left_anti")
    fresh = build_blocks(rebuild_listing, plan, valid_only=True)
    fresh_rows = fresh.block_rows  # numbered once, for the heads too
    heads = reuse.select(*fresh.block_heads.columns).unionByName(fresh.block_heads)
    rows = (old_rows.join(reuse.select("block_id"), "block_id", "left_semi")
            .select(*fresh_rows.columns).unionByName(fresh_rows))
    return heads, rows
