"""Consecutive numbering of rows that does not put a big group in one task.

``row_number().over(Window.partitionBy(folder).orderBy(key))`` sends every
row of a folder to one task; a folder holding a third of all files would
then sort a third of the data on one core. ``ranged_index`` instead:

1. range-partitions on (group keys, order keys), so a hot group is spread
   over many partitions in key order, and sorts inside each partition;
2. tags each row with its partition id and position in the partition and
   writes the tagged rows to the shared checkpoint folder: the tags are
   columns of a written table, so the count pass and the join pass read the
   same values even if range sampling or a lost executor would place rows
   differently on a second evaluation;
3. counts rows per (partition, group) - a table no larger than
   partitions + groups - and turns the counts into per-group offsets with a
   running sum over partitions, written so that Spark knows their size;
4. joins the offsets back: index = offset + position - first position. Where
   the offsets are small they are broadcast and the rows stay where they are.

The result equals ``row_number() - 1`` over the window when the order keys
are unique within a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _parallelism(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism)


def ranged_index(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str],
                 out: str = "idx", base: int = 0,
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based (plus ``base``) position of each row inside its
    ``group_by`` group, ordered by ``order_by`` (unique within a group)."""
    group_by, order_by = list(group_by), list(order_by)
    keys = group_by + order_by
    n = num_partitions or _parallelism(df)
    ranged = (df.repartitionByRange(n, *keys)
              .sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id()))
    ranged = materialize(ranged)
    stats = (ranged.groupBy("_pid", *group_by)
             .agg(F.count(F.lit(1)).alias("_cnt"), F.min("_pos").alias("_first")))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    if group_by:
        w = Window.partitionBy(*group_by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_offset", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    stats = materialize(stats.select("_pid", *group_by, "_offset", "_first"), "offsets")
    joined = ranged.join(stats, ["_pid", *group_by])
    idx = F.col("_offset") + F.col("_pos") - F.col("_first") + F.lit(base)
    return joined.withColumn(out, idx).drop("_pid", "_pos", "_offset", "_first")


def window_index(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str],
                 out: str = "idx", base: int = 0) -> DataFrame:
    """Plain window numbering: the check of ``ranged_index`` in the tests."""
    w = Window.partitionBy(*group_by).orderBy(*order_by) if group_by else Window.orderBy(*order_by)
    return df.withColumn(out, (F.row_number().over(w) - 1 + F.lit(base)).cast("bigint"))
