"""Self-counters of a stream by time window.

A running sum needs an end: windows close once the watermark passes them and are written once, in append mode. What comes too
late for its window is counted apart, by the rows that the first stateful operator drops.
"""

from __future__ import annotations

import threading
from typing import Any, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from beaconry.constants import KEYS, TagKeys
from beaconry.operators.counters import counted
from beaconry.operators.enrich import attribute_batches
from beaconry.operators.stats import profile_batches
from beaconry.streaming.redelivery import first_deliveries

LATE = "query_id string, epoch bigint, late_batches bigint, watermark string"


def windowed_counters(stats: DataFrame, window: str, keys: TagKeys = KEYS, at: str = "received_at") -> DataFrame:
    """Items ingested per window, signal, source and safe tenant. ``stats`` is a stream with a watermark, or a table.

    Partial sums leave a task as one row per window, source and tenant, so a hot source does not meet in one task.
    """
    rows = counted(stats, keys, F.window(at, window).alias("window"))
    sums = rows.groupBy("window", "metric", "source_name", "tenant_id").agg(F.sum("item_count").alias("value"))
    return sums.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                       "metric", "source_name", "tenant_id", "value")


def batch_rows(envelopes: DataFrame, signal: str) -> DataFrame:
    """The columns of each batch that counters need, attributed to its source and tenant."""
    return attribute_batches(profile_batches(envelopes, signal, records=False)).select(
        "received_at", "signal", "item_count", "source_name", "batch_tenant")


class LateBatches(StreamingQueryListener):
    """Writes how many batches the watermark made a named query drop: one small table per epoch that dropped any."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name
        self.runs: set[str] = set()
        self.ended = threading.Event()

    def onQueryStarted(self, event: Any) -> None:
        if event.name == self.name:
            self.runs.add(str(event.runId))
            self.ended.clear()

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        if p.name != self.name or not p.stateOperators:
            return
        # the last operator listed is the first that rows pass: the de-duplication by key, where a row is a batch
        late = p.stateOperators[-1].numRowsDroppedByWatermark
        if late:
            row = [(str(p.id), p.batchId, late, (p.eventTime or {}).get("watermark"))]
            self.spark.createDataFrame(row, LATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/query={p.id}/epoch={p.batchId}")

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        if str(event.runId) in self.runs:
            self.ended.set()


def late_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LATE).option("recursiveFileLookup", "true").parquet(path)


def count_stream(envelopes: DataFrame, signal: str, out: str, checkpoint: str, window: str = "1 minute",
                 lateness: str = "10 minutes", keys: TagKeys = KEYS, name: str | None = None,
                 trigger: Mapping[str, Any] | None = None) -> StreamingQuery:
    """Write closed windows to the table ``out``, once each, also across restarts from ``checkpoint``.

    Redelivered batches count once within ``lateness``. Batches older than the watermark are dropped; a listener
    ``LateBatches`` of the same ``name`` records them.
    """
    once = first_deliveries(envelopes, lateness)
    sums = windowed_counters(batch_rows(once, signal), window, keys)
    writer = sums.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    if name is not None:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start()
