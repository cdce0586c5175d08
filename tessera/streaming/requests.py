"""Sync on request, as a Structured Streaming query.

Clients drop small JSON request files ``{"request_id": ..., "force": ...}``
into a folder. Each micro-batch of requests runs one sync of the current
listing (forced when any request in the batch asks for it) and writes one
response row per request - ``(request_id, updated, version, updated_at)`` -
under ``batch_id=N`` of the response folder. ``checkpoint_location`` is
required: a query restarted with it resumes where it stopped, and a batch that
runs again overwrites its own responses, so each request has one answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.sync import sync
from ..sources.store import VersionedStore

REQUEST_SCHEMA = "request_id string, force boolean"


def serve_sync_requests(spark: SparkSession, requests_dir: str, listing: Callable[[], DataFrame],
                        rules: DataFrame, store: VersionedStore, responses_dir: str, *,
                        checkpoint_location: str, available_now: bool = False,
                        interval: str = "30 seconds") -> StreamingQuery:
    """Start the request stream. ``listing`` returns the live listing when
    called (it is re-read for every batch)."""
    requests = spark.readStream.schema(REQUEST_SCHEMA).json(requests_dir)

    def answer(batch: DataFrame, batch_id: int) -> None:
        force = batch.agg(F.max(F.coalesce("force", F.lit(False)))).first()[0]
        if force is None:  # empty batch
            return
        status = sync(store, listing(), rules, force=bool(force)).first()
        (batch.select("request_id",
                      F.lit(status["updated"]).alias("updated"),
                      F.lit(status["version"]).cast("bigint").alias("version"),
                      F.lit(str(status["updated_at"])).cast("timestamp_ntz").alias("updated_at"))
         .write.mode("overwrite").parquet(f"{responses_dir}/batch_id={batch_id}"))

    writer = (requests.writeStream.foreachBatch(answer)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
