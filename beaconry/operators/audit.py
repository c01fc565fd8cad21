"""Batch status and the audit event of each batch."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.constants import (
    ANALYTICS, CONTRACT_VERSION, LOGS, METRICS, STATUS_PARTIAL, STATUS_SUCCESS, TRACES)
from beaconry.context import CollectorOptions, Context
from beaconry.functions.maps import entries
from beaconry.operators.enrich import metadata_entries
from beaconry.operators.routing import DELIVERED


def failures_in(routes: Column, failed_sinks: Iterable[str]) -> Column:
    """How many of a row's delivered routes went to sinks that failed.

    The sinks of one fan-out are few and known, so this needs neither ledger join nor shuffle.
    """
    failed = list(failed_sinks)
    if not failed:
        return F.lit(0)
    return F.size(F.filter(routes, lambda r: (r["decision"] == DELIVERED) & r["sink"].isin(*failed)))


def status_of(failures: Column) -> Column:
    return F.when(failures > 0, STATUS_PARTIAL).otherwise(STATUS_SUCCESS)


def failure_message(failures: Column) -> Column:
    return F.when(failures > 0, F.concat(failures.cast("string"), F.lit(" sink(s) failed to export")))


def batch_status(delivery: DataFrame) -> DataFrame:
    """Status per batch from a delivery table (``batch_id, sink, ok``)."""
    counted = delivery.groupBy("batch_id").agg(F.count_if(~F.col("ok")).alias("sink_failures"))
    n = F.col("sink_failures")
    return counted.select("batch_id", "sink_failures", status_of(n).alias("status"),
                          failure_message(n).alias("error_message"))


def with_failures(stats: DataFrame, delivery: DataFrame) -> DataFrame:
    """Attach the failure count of a delivery table. Only failures are joined, not every delivery."""
    failed = delivery.filter(~F.col("ok")).groupBy("batch_id").agg(F.count("*").alias("sink_failures"))
    return stats.join(failed, "batch_id", "left").withColumn(
        "sink_failures", F.coalesce("sink_failures", F.lit(0).cast("bigint")))


def ingestion_audit(stats: DataFrame, ctx: Context = Context(), opts: CollectorOptions = CollectorOptions(),
                    duration_ms: Column | None = None) -> DataFrame:
    """One audit event per batch from attributed statistics with ``sink_failures``.

    The audit id is a hash of batch and signal, so a rerun writes the same event. A duration that nobody measured is null.
    """
    n = F.col("sink_failures")

    def count(signal: str) -> Column:
        return F.when(F.col("signal") == signal, F.col("item_count")).otherwise(0).cast("bigint")

    meta = F.concat(
        F.when(n > 0, entries([(opts.keys.sink_failures, n.cast("string"))])).otherwise(entries([])),
        metadata_entries(F.col("source_name"), ctx, opts, F.col("received_at")))
    return stats.select(
        F.lit(CONTRACT_VERSION).alias("version"), F.col("received_at").alias("ingestion_timestamp"),
        F.md5(F.concat_ws("/", "signal", "batch_id")).alias("audit_id"), "batch_id",
        F.col("source_name").alias("source_node_name"), "source_node_id", ctx.col("correlation_id").alias("correlation_id"),
        count(TRACES).alias("trace_count"), count(METRICS).alias("metric_count"), count(LOGS).alias("log_count"),
        count(ANALYTICS).alias("analytics_event_count"), status_of(n).alias("status"),
        failure_message(n).alias("error_message"),
        (F.lit(None) if duration_ms is None else duration_ms).cast("bigint").alias("processing_duration_ms"),
        F.map_from_entries(meta).alias("metadata"))


def publishable(audit: DataFrame) -> DataFrame:
    """Audit events with a correlation id in any case: a stable hash where there is none."""
    given = F.when(F.trim("correlation_id") != "", F.col("correlation_id"))
    return audit.withColumn("correlation_id", F.coalesce(given, F.md5(F.col("audit_id"))))
