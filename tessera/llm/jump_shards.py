"""Sharding by jump consistent hashing.

``shard(key, n)`` follows Lamping and Veach, "A Fast, Minimal Memory,
Consistent Hash Algorithm": no ring table, and going from n to n + 1 shards
moves about 1/(n + 1) of the keys, all of them into the new shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.frames import quoted, set_aside


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard below ``n`` of each unsigned 64-bit key."""
    key = keys.astype(np.uint64)
    b = np.full(len(key), -1, np.int64)
    j = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        scale = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        j[live] = np.minimum((b[live] + 1) * scale, float(n)).astype(np.int64)
        live = live[j[live] < n]
    return b.astype(np.int32)


def shard(key: Column, n: int) -> Column:
    """Shard (0 to n - 1) of a long column of well mixed keys."""

    @F.pandas_udf("int")
    def jumped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), n))

    return jumped(key)


def assign(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Adds ``size`` (UTF-8 bytes of the text plus 8), ``shard``, ``slot`` and
    ``grown_shard`` (with n + 1 shards) to ``docs``.

    Only the key and the shard count decide the shard. Slots are 0, 1, ...
    within each shard, in an order fixed by key and text. A shard is numbered
    in ``parts`` sub-buckets by many tasks (default: the session's shuffle
    partitions over the shards); their counts, a table of n * parts rows,
    give each sub-bucket its first slot.

    A null key counts as one stable key; a null text has no bytes; repeated
    rows get the same shard and different slots; an empty table gives an empty
    result; other columns pass through, and columns named like the added ones
    are replaced.
    """
    spark = docs.sparkSession
    parts = parts or 1 + int(spark.conf.get("spark.sql.shuffle.partitions")) // n
    aside, back = set_aside(docs, "size", "shard", "slot", "grown_shard")
    key, text = F.col(quoted(key)), F.col(quoted(text))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"shard": shard(F.col("mixed"), n),
                               "part": F.pmod(F.shiftright("mixed", 20), F.lit(parts)).cast("int")})

    mixed = F.xxhash64(F.lit("shard"), key).alias("mixed")
    starts = placed(docs.select(mixed)).groupBy("shard", "part").agg(F.count("*").alias("rows"))
    starts = starts.select("shard", "part", (F.sum("rows").over(Window.partitionBy("shard").orderBy("part")) - F.col("rows")).alias("start"))
    rows = placed(docs.select(*aside, mixed, key.alias("key"), F.xxhash64(text).alias("tie"),
                              (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size")))
    rows = rows.withColumn("grown_shard", shard(F.col("mixed"), n + 1))
    order = Window.partitionBy("shard", "part").orderBy(F.col("key").asc_nulls_first(), "tie")
    return (rows.withColumn("at", F.row_number().over(order).cast("long") - 1).join(starts, ["shard", "part"])
            .select(*back, "size", "shard", (F.col("start") + F.col("at")).alias("slot"), "grown_shard"))
