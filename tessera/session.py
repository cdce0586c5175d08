"""Session helpers: a tuned local session for tests/bench and the shared
checkpoint folder every lineage cut goes through."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Settings a batch job wants on any cluster: AQE re-plans joins and
# partition counts at runtime and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tessera") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Partition sizing for a run over ``input_bytes`` of listing data.

    Scan splits and shuffle partitions aim at ``target_partition_bytes``
    each, so a task's share fits executor memory and spills rarely; AQE
    coalesces small shuffle partitions and splits skewed join partitions.
    Apply with ``SparkSession.builder.config(map=scale_conf(...))``.
    """
    parts = max(200, -(-input_bytes // target_partition_bytes))
    return {
        **DEFAULT_CONF,
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Uses the directory the cluster configured (``spark.checkpoint.dir``);
    only a local session with none configured gets a folder under /tmp.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/object store) so checkpoints survive executor loss")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "stage", **measures: Column) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder
    and read it back. Cuts lineage (a lost executor re-reads files instead
    of recomputing the plan) and fixes the rows, so a table that is read
    several times (count pass, numbering pass, several outputs) is computed
    once. Unlike ``Dataset.checkpoint``, which runs its input twice (the
    eager count, then the file write), this runs it once. ``measures``: aggregates
    that the write observes as it passes the rows; then (table, their values)
    is returned."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if measures:
        seen = Observation(path)
        df = df.observe(seen, *[c.alias(k) for k, c in measures.items()])
    df.write.mode("overwrite").parquet(path)
    for job in _SCRATCH:
        job.append(path)
    table = spark.read.parquet(path)
    return (table, seen.get) if measures else table


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch_job(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``materialize`` writes inside the block when it
    ends, so a job whose results are committed elsewhere leaves nothing. Frames
    that still read those tables must not be used afterwards."""
    written: list[str] = []
    _SCRATCH.append(written)
    try:
        yield
    finally:
        _SCRATCH.remove(written)
        for path in written:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
