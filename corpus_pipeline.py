"""The corpus pipeline: documents through five of the operators in turn.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept and returns a DataFrame; run() writes each as Parquet in the shared
folder and reads it again as the next one's documents.

1. quality: documents that the quality rules reject go; lines that are common
   to many documents of a source go from the others.
2. near_duplicates: one document of each near-duplicate class stays.
3. decontamination: documents that hold a benchmark item go.
4. mixing: each source is taken by its target; a document comes once for each
   time that it is drawn, with the words that are drawn. Words of a block that
   is drawn in part are joined by single spaces; a whole draw keeps its text.
5. sharding: every row gets its shard by doc_id, and a slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jump_shards, line_quality, mix, order_minhash
from tessera.session import materialize

SHARDS = 24

#: Rows that a Python worker gets at a time. Rows hold whole texts, and workers keep
#: their peak memory from stage to stage.
BATCH_ROWS = "500"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with n_chars as the text now is, in the order of ``columns``."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return _counted(line_quality.judge(docs, cut=True).where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.matched(docs, items).where(F.size("leaks") == 0).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mix.drawn_texts(mix.mix(docs)), docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jump_shards.assign(docs, SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The stages' classes, fingerprints and draws aren't SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
