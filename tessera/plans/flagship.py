"""Flagship query: FASTQ run folders pivoted to one row per sample/lane
with its R1 and R2 files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouping import NameGrouping
from ..session import materialize
from ..sources.derived import runs_listing
from ..sources.rules import rules_frame
from ..sources.tables import Tables


def runs_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = NameGrouping(materialize(runs_listing(Tables(spark, sf_dir)), "listing"), rules_frame(spark))
    v = g.valid_groups()
    return v.select("folder_path", "row_number", "row_key",
                    F.try_element_at("cells", F.lit("R1")).alias("R1"),
                    F.try_element_at("cells", F.lit("R2")).alias("R2"))
