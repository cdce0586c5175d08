"""Connected components of a link table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); ``label`` is the least
    node of its component. Empty links give an empty table.

    Each round takes the least label among a node and its neighbours, then the
    label of that label, so paths halve; it is written to the shared folder.
    Only the number of changed labels reaches the driver. Neighbours are
    combined before the shuffle, and a node with very many links is a skewed
    join side that Spark splits.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
        "node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = materialize(least.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels
